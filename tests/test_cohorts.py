"""Greedy cohorts and shortlists against a plain greedy choice."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import cohorts

SCHEMA = "id long, tags array<string>, score double"


def data(seed, n=120):
    rng = random.Random(seed)
    return [(i, [rng.choice(["a", "b", "c", "d", "e", "f", None]) for _ in range(rng.randrange(4))] or None, rng.choice([None, 1.0, 2.5, 2.5])) for i in range(n)]


def digest(namespace, i):
    return int(hashlib.sha256(f"{namespace}:{i}".encode()).hexdigest(), 16)


def plain_cover(rows, limit):
    sets = {i: {t for t in tags or () if t} for i, tags, _ in rows}
    left, out = set().union(*sets.values()), []
    while left and len(out) < limit:
        best = max((i for i in sets if i not in out), key=lambda i: (len(sets[i] & left), -digest("cohort", i)))
        out.append(best)
        left -= sets[best]
    fill = sorted((i for i in sets if i not in out), key=lambda i: digest("cohort", i))[: limit - len(out)]
    return [(i, "coverage") for i in out] + [(i, "fill") for i in fill]


def plain_short(rows, wanted, limit, enough):
    left, out = set(wanted), []
    rest = {i: ({t for t in tags or () if t}, s or 0.0) for i, tags, s in rows}
    while rest and len(out) < limit:
        best = max(rest, key=lambda i: (len(rest[i][0] & left), rest[i][1], digest("demo", i)))
        left -= rest.pop(best)[0]
        out.append(best)
        if not left and len(out) >= enough:
            break
    return out


@pytest.mark.parametrize("sets", [100_000, 3])
@pytest.mark.parametrize("limit", [2, 9, 500])
def test_cover(spark, sets, limit):
    rows = data(limit)
    got = cohorts.cover_and_fill(spark.createDataFrame(rows, SCHEMA), "id", "tags", limit, sets=sets).orderBy("position").collect()
    assert [(r.id, r.reason) for r in got] == plain_cover(rows, limit)
    assert [r.position for r in got] == list(range(1, min(limit, len(rows)) + 1))


@pytest.mark.parametrize("sets", [100_000, 3])
def test_shortlist(spark, sets):
    for wanted, limit, enough in ((("a", "b", "c"), 12, 8), (("a", "x"), 5, 2), ((), 4, 2)):
        rows = data(limit + enough)
        got = cohorts.diverse_shortlist(spark.createDataFrame(rows, SCHEMA), "id", "tags", F.col("score"), wanted, limit=limit, enough=enough, sets=sets).orderBy("position")
        assert [r.id for r in got.collect()] == plain_short(rows, wanted, limit, enough)


def test_nothing_to_choose(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cohorts.cover_and_fill(none, "id", "tags", 5).collect() == [] and cohorts.diverse_shortlist(none, "id", "tags", F.col("score"), ("a",)).collect() == []


def test_jobs_do_not_grow_with_choices(spark):
    rows = spark.createDataFrame([(i, [f"t{i}"], 0.0) for i in range(60)], SCHEMA).coalesce(1)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cohort", "cohort")
    assert cohorts.cover_and_fill(rows, "id", "tags", 40).count() == 40
    jobs = len(tracker.getJobIdsForGroup("cohort"))
    spark.sparkContext.setJobGroup("default", "default")
    assert jobs <= 6  # one choice, its stages and the count of the result; not 40
