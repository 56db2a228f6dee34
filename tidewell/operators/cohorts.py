"""Small sets of rows that stand for many: greedy coverage of tags, then a fill in reproducible random order."""

from __future__ import annotations

import heapq
from collections.abc import Collection, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .history import stable_hash_order

#: Distinct sets of tags up to which the choice is made on the driver; beyond, each step is a job over the sets.
SETS = 100_000


def _best_of_sets(rows: DataFrame, key: str, tags: str, score: Column | None, namespace: str, largest: bool, each: int) -> DataFrame:
    """(tags, score, hash, key): the first `each` rows of every distinct set of tags, by score, then hash.

    The window keeps `each` rows a set in every task before the shuffle, so a set that most rows share costs no more than another.
    """
    value = F.coalesce(score.cast("double"), F.lit(0.0)) if score is not None else F.lit(0.0)
    digest = stable_hash_order(namespace, F.col(key))
    found = rows.select(F.array_sort(F.array_distinct(tags)).alias("tags"), value.alias("score"), digest.alias("hash"), F.col(key).alias("key"))
    order = [F.desc("score"), F.desc("hash") if largest else F.asc("hash"), F.asc("key")]
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("tags").orderBy(*order))).where(F.col("_k") <= each).drop("_k")


def lazy_greedy(rows: Collection[tuple[Collection[str], float, str, object]], wanted: Collection[str] | None, largest: bool, all_first: bool) -> Iterator[tuple[object, Collection[str], int]]:
    """(key, tags, uncovered tags it adds) of (tags, score, hash, key) rows: most uncovered tags, then score, then hash.

    What a row adds only falls as others are chosen, so a row whose old count is
    still the largest after it is counted anew is the best of all: few are
    counted again.  With all_first it ends once nothing is uncovered.
    """
    left = {t for tags, *_ in rows for t in tags} if wanted is None else set(wanted)
    heap = [(-len(left.intersection(tags)), -score, (-1 if largest else 1) * int(digest, 16), i, key, tags) for i, (tags, score, digest, key) in enumerate(rows)]
    heapq.heapify(heap)
    while heap and (left or not all_first):
        count, *rest = heapq.heappop(heap)
        now = -len(left.intersection(rest[-1]))
        if now != count:
            heapq.heappush(heap, (now, *rest))
            continue
        if all_first and not now:
            return
        left.difference_update(rest[-1])
        yield rest[-2], rest[-1], -now


def _greedy_by_jobs(sets: DataFrame, wanted: Collection[str] | None, largest: bool, all_first: bool) -> Iterator[tuple[object, Collection[str], int]]:
    """lazy_greedy over a table of sets too large for the driver: a job for each choice."""
    left = {r.t for r in sets.select(F.explode("tags").alias("t")).distinct().collect()} if wanted is None else set(wanted)
    chosen: list = []
    while left or not all_first:
        adds = F.size(F.array_intersect("tags", F.array(*map(F.lit, sorted(left))))) if left else F.lit(0)
        rest = sets.where(~F.col("key").isin(chosen)) if chosen else sets
        best = rest.withColumn("_n", adds).orderBy(F.desc("_n"), F.desc("score"), F.desc("hash") if largest else F.asc("hash")).limit(1).collect()
        if not best or (all_first and not best[0]["_n"]):
            return
        left.difference_update(best[0].tags)
        chosen.append(best[0].key)
        yield best[0].key, best[0].tags, best[0]["_n"]


def _greedy(rows: DataFrame, key: str, tags: str, score: Column | None, namespace: str, largest: bool, each: int, wanted: Collection[str] | None, all_first: bool, sets: int):
    found = _best_of_sets(rows, key, tags, score, namespace, largest, each)
    first = found.limit(sets + 1).collect()
    if len(first) <= sets:
        return lazy_greedy([tuple(r) for r in first], wanted, largest, all_first)
    return _greedy_by_jobs(settled(found), wanted, largest, all_first)


def cover_and_fill(rows: DataFrame, key: str, tags: str, limit: int, *, namespace: str = "cohort", sets: int = SETS) -> DataFrame:
    """(key, position, reason, tags): at most `limit` rows that cover all tags greedily, filled up by hash.

    Of rows that add as many uncovered tags the smallest hash is taken.  Rows are
    reduced to one of each distinct set of tags; the choice among these is one
    job, the fill another.  Keys are unique; null tags count as none.
    """
    rows = rows.select(key, F.coalesce(F.filter(tags, lambda t: t.isNotNull()), F.array().cast("array<string>")).alias(tags))
    chosen = []
    for k, own, _ in _greedy(rows, key, tags, None, namespace, False, 1, None, True, sets):
        chosen.append((k, len(chosen) + 1, "coverage", sorted(own)))
        if len(chosen) == limit:
            break
    if len(chosen) < limit:
        names = [k for k, *_ in chosen]
        rest = rows.where(~F.col(key).isin(names)) if names else rows
        more = rest.orderBy(stable_hash_order(namespace, F.col(key)), key).limit(limit - len(chosen)).collect()
        chosen += [(r[key], len(chosen) + i, "fill", sorted(set(r[tags]))) for i, r in enumerate(more, 1)]
    return rows.sparkSession.createDataFrame(chosen, f"{key} {rows.schema[key].dataType.simpleString()}, position int, reason string, tags array<string>")


def diverse_shortlist(rows: DataFrame, key: str, tags: str, score: Column, wanted: Collection[str], *, limit: int = 12, enough: int = 8, namespace: str = "demo", sets: int = SETS) -> DataFrame:
    """(key, position, adds): up to `limit` rows, each the one with most wanted tags that none before has, then the best score, then the largest hash.

    It ends at `enough` rows if no wanted tag is left that a row could add.
    """
    rows = rows.select("*", F.coalesce(F.filter(tags, lambda t: t.isin(*wanted)), F.array().cast("array<string>")).alias("_tags"))
    left, chosen = set(wanted), []
    for k, own, adds in _greedy(rows, key, "_tags", score, namespace, True, limit, wanted, False, sets):
        chosen.append((k, len(chosen) + 1, adds))
        left.difference_update(own)
        if len(chosen) == limit or (not left and len(chosen) >= enough):
            break
    return rows.sparkSession.createDataFrame(chosen, f"{key} {rows.schema[key].dataType.simpleString()}, position int, adds int")
