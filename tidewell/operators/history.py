"""Observation histories: latest state, changes, runs of absence, samples and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each key's last row by the order columns; one hash aggregation, no sort of whole histories."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*")


def with_previous(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Adds `previous`, a struct of the fields in the key's preceding row; null for the first."""
    return rows.withColumn("previous", F.lag(F.struct(*fields)).over(Window.partitionBy(key).orderBy(*order)))


def changed_fields(fields: Sequence[str], before: str = "previous") -> Column:
    """Names of the fields that differ from the struct before, all of them if there is none; null equals null."""
    parts = [F.when(F.col(before).isNull() | ~F.col(f).eqNullSafe(F.col(f"{before}.{f}")), F.lit(f)) for f in fields]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def normalized(text: Column) -> Column:
    """Lower case, single blanks, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lifecycle_change(status: Column, previous: Column) -> Column:
    """removed / reactivated where the status crosses, else null; the first observation crosses nothing."""
    gone, was_gone = status == "removed", previous == "removed"
    return F.when(previous.isNotNull() & gone & ~was_gone, "removed").when(previous.isNotNull() & ~gone & was_gone, "reactivated")


def change_origin(changed: Column, text_changed: Column, mentions_price: Column) -> Column:
    """Whether a change of price comes from the source, a new reading of the same text, or can't be told."""
    return F.when(~changed, F.lit(None).cast("string")).when(text_changed & mentions_price, "source_change").when(~text_changed, "reinterpretation").otherwise("unknown")


def top_events(rows: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The newest n rows of each key with has_more."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"event_no": F.row_number().over(w.orderBy(*order)), "_total": F.count("*").over(w)})
    return ranked.where(F.col("event_no") <= n).withColumn("has_more", F.col("_total") > n).drop("_total")


def absence_runs(seen: DataFrame, runs: DataFrame, key: str, run: str, removed_after: int = 2) -> DataFrame:
    """(key, last run, missed, status): runs in a row without the key up to the last run.

    The run calendar is numbered once; a key's missed runs are the distance from
    its last run to the calendar's end, so no key is crossed with every run.
    """
    numbered = runs.select(run).distinct().withColumn("_no", F.row_number().over(Window.orderBy(run)))  # a row per run
    last = seen.groupBy(key).agg(F.max(run).alias(run)).join(F.broadcast(numbered), run)
    end = F.broadcast(numbered.agg(F.max("_no").alias("_end")))
    out = last.join(end).withColumn("missed", F.col("_end") - F.col("_no"))
    status = F.when(F.col("missed") == 0, "active").when(F.col("missed") < removed_after, "possibly_removed").otherwise("removed")
    return out.withColumn("status", status).select(key, F.col(run).alias("last_run"), "missed", "status")


def numbered(rows: DataFrame, by: str, tie: str, name: str, buckets: int = 200) -> DataFrame:
    """Adds the 0-based position of each row in the order (by, tie), nulls first, without one task for all rows.

    `by` is numeric.  Approximate quantiles cut it into ranges; a range's rows
    are numbered in their own task and shifted by the count of the ranges before.
    """
    cuts = sorted(set(rows.approxQuantile(by, [i / buckets for i in range(1, buckets)], 0.01)))
    part = F.lit(0)
    if cuts:
        part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(by).cast("double"))) + 1, F.lit(0))
    rows = rows.withColumn("_part", F.when(F.col(by).isNull(), 0).otherwise(part))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(counts.select("_part", before.alias("_before")))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_first(by), tie)) - 1
    return rows.withColumn("_own", own).join(shift, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def spread_sample(rows: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """k rows spread evenly over the order (by, tie), first and last included; all rows if there are fewer."""
    n = rows.count()
    if n <= k:
        return rows
    picks = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 else [0]
    return numbered(rows, by, tie, "_at").where(F.col("_at").isin(picks)).drop("_at")


def stable_hash_order(namespace: str, key: Column) -> Column:
    """A reproducible random order of keys."""
    return F.sha2(F.concat(F.lit(f"{namespace}:"), key.cast("string")), 256)


def batches(rows: DataFrame, order: Sequence[Column], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds batch, numbering runs of `size` rows in order within each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def supersede_chain(decisions: DataFrame, base: str, order: Sequence[str]) -> DataFrame:
    """Adds superseded_by, the next decision of the same base, and active where there is none."""
    rows = decisions.withColumn("superseded_by", F.lead(order[-1]).over(Window.partitionBy(base).orderBy(*order)))
    return rows.withColumn("active", F.col("superseded_by").isNull())


def page_stop(pages: DataFrame, page: str, urls: str) -> DataFrame:
    """Pages up to the stop: an empty page, one that repeats an earlier page, or one with no new url.

    Adds new_urls and seen (new urls so far).  First sightings are one
    aggregation over urls; the page table itself has a row per page.
    """
    signature = F.sha2(F.array_join(F.array_sort(F.array_distinct(urls)), "\n"), 256)
    first = pages.select(page, F.explode(urls).alias("url")).groupBy("url").agg(F.min(page).alias(page)).groupBy(page).agg(F.count("*").alias("new_urls"))
    rows = pages.withColumn("_s", signature).join(first, page, "left").withColumn("new_urls", F.coalesce("new_urls", F.lit(0)))
    again = F.row_number().over(Window.partitionBy("_s").orderBy(page)) > 1
    rows = rows.withColumn("_stop", (F.size(urls) == 0) | again | (F.col("new_urls") == 0))
    end = rows.where("_stop").agg(F.coalesce(F.min(page), F.lit(2**62)).alias("_end"))
    kept = rows.join(F.broadcast(end)).where(F.col(page) < F.col("_end"))
    return running_sum(kept.select(page, "new_urls"), page, "new_urls", "seen")


def running_sum(rows: DataFrame, by: str, value: str, name: str, ranges: int = 1000) -> DataFrame:
    """Adds the sum of value up to each row by a number: sums of ranges first, then within each range; no task orders all rows."""
    ends = rows.agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    place = F.least(F.lit(ranges - 1), F.floor((F.col(by) - F.col("_low")) * ranges / F.greatest(F.col("_high") - F.col("_low"), F.lit(1)))).cast("int")
    parts = rows.join(F.broadcast(ends)).withColumn("_range", place).drop("_low", "_high")
    before = parts.groupBy("_range").agg(F.sum(value).alias("_sum"))  # a row per range
    before = before.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(by))
    return parts.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")


def grid_round_robin(points: DataFrame, x: str, y: str, key: str, bins: int, n: int) -> DataFrame:
    """n points taken in turn from the cells of a bins x bins grid, each cell in key order."""
    box = points.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    cell = lambda v, low, high: F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(low)) * bins / F.greatest(F.col(high) - F.col(low), F.lit(1e-9))))
    rows = points.join(F.broadcast(box)).withColumn("cell", cell(x, "_x0", "_x1") * bins + cell(y, "_y0", "_y1")).drop("_x0", "_x1", "_y0", "_y1")
    deep = rows.withColumn("depth", F.row_number().over(Window.partitionBy("cell").orderBy(key)))
    return deep.orderBy("depth", "cell", key).limit(n)
