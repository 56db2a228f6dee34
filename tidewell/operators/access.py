"""Travel samples and profiles: aggregation, reuse, freshness, quality, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days that a profile lives, by mode.
TTL_DAYS = {"walking": 180, "cycling": 180, "transit": 30}
# Reasons that ask for a person's look.
REVIEW_REASONS = ("duration_outlier", "distance_outlier", "impossible_speed", "origin_snap_too_far", "destination_snap_too_far", "insufficient_samples", "unexpected_no_route", "version_mismatch")


def int_median(value: Column) -> Column:
    """Median of whole numbers, halves up."""
    return F.floor(F.median(value) + 0.5)


def aggregate_profile(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Profile of each group: counts, median, range, the representative sample and confidence.

    Valid samples are available or estimated ones with a duration.  The
    representative is the one closest to the median, then the earliest; its
    fields travel in one struct, so samples are grouped twice and never sorted.
    """
    valid = F.col("duration_seconds").isNotNull() & F.col("status").isin("available", "estimated")
    rows = samples.withColumn("_v", F.when(valid, F.col("duration_seconds")))
    stats = rows.groupBy(*by).agg(F.count("*").alias("expected"), F.count("_v").alias("valid"), F.median("_v").alias("median"), F.min("_v").alias("shortest"), F.max("_v").alias("longest"))
    ranked = rows.where("_v is not null").join(stats.select(*by, "median"), list(by))
    pick = ranked.groupBy(*by).agg(F.min(F.struct(F.abs(F.col("_v") - F.col("median")).alias("gap"), "departure_at", "sample_id", "sample_line", F.col("_v").alias("duration"))).alias("r"))
    out = stats.join(pick, list(by), "left")
    confidence = F.bround(F.least(F.lit(1.0), F.col("valid") / F.col("expected") * 0.95), 3)
    return out.select(*by, "expected", "valid", "median", "shortest", "longest", F.col("r.duration").alias("representative"), F.col("r.departure_at").alias("departure_at"), confidence.alias("confidence"))


def sample_outcome(codes: Column, status: Column) -> Column:
    """available, no_route, walking_better or other, by the exact set of pipe-joined diagnostic codes."""
    names = F.array_sort(F.array_distinct(F.split(codes, r"\|")))
    return F.when(status == "available", "available").when(names == F.array(F.lit("no_route")), "no_route").when(names == F.array(F.lit("walking_better")), "walking_better").otherwise("other")


def reusable_sample(codes: Column, status: Column, deterministic: Sequence[str] = ("no_route", "walking_better")) -> Column:
    """A sample may be reused if it is available, or unavailable for reasons that a new call would repeat."""
    names = F.split(codes, r"\|")
    known = codes.isNotNull() & (F.size(F.array_except(names, F.array(*map(F.lit, deterministic)))) == 0)
    return (status == "available") | ((status == "unavailable") & known)


def route_reasons(mode: Column, duration: Column, distance: Column, straight: Column, origin_snap: Column, target_snap: Column) -> Column:
    """What is odd about a direct route, sorted."""
    speed = distance / duration
    low = F.when(mode == "walking", 0.4).when(mode == "cycling", 1.5)
    high = F.when(mode == "walking", 2.7).when(mode == "cycling", 13.0)
    parts = (
        F.when(duration.isNull() | (duration <= 0) | (duration > 4 * 3600), "duration_outlier"),
        F.when(distance.isNull() | (distance <= 0) | (distance > 100_000), "distance_outlier"),
        F.when((duration > 0) & (distance > 0) & ~speed.between(low, high), "impossible_speed"),
        F.when((straight > 0) & (duration > 0) & (distance / straight > 3.5), "excessive_detour"),
        F.when(origin_snap > 200, "origin_snap_too_far"),
        F.when(target_snap > 200, "destination_snap_too_far"),
    )
    return F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull()))


def decision(reasons: Column, failed: Column) -> Column:
    review = F.array(*map(F.lit, REVIEW_REASONS))
    return F.when(failed, "failed").when(F.arrays_overlap(reasons, review), "manual_review_required").when(F.size(reasons) > 0, "accepted_with_warning").otherwise("accepted")


def transit_quality(valid: Column, requested: Column, least: int) -> Column:
    return F.when(valid == 0, "no_route").when(valid < least, "insufficient_samples").when(valid < requested, "partial").otherwise("complete")


def transport_status(stale: Column, result_type: Column, outcome: Column, duration: Column) -> Column:
    """The first of: stale, technical, walking_better, no_route, partial, available."""
    return (
        F.when(stale, "stale")
        .when(result_type == "error", "technical")
        .when(outcome == "walking_better", "walking_better")
        .when(duration.isNull(), "no_route")
        .when(outcome == "partial", "partial")
        .otherwise("available")
    )


def expiry(mode: Column, calculated_at: Column) -> Column:
    days = F.when(mode == "transit", TTL_DAYS["transit"]).otherwise(TTL_DAYS["walking"])
    return calculated_at + F.make_dt_interval(days=days)


def stale_reason(expires_at: Column, at: Column, version: Column, current: str) -> Column:
    return F.when(expires_at <= at, "expired").when(~version.eqNullSafe(F.lit(current)), "version_changed")


def profile_upsert(stored: DataFrame, new: DataFrame, identity: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One current row per identity: the new value under the stored id."""
    both = stored.select(*identity, F.col("profile_id").alias("_id"), F.struct(*fields).alias("_old")).join(new.select(*identity, F.col("profile_id").alias("_new_id"), F.struct(*fields).alias("_new")), list(identity), "full")
    return both.select(*identity, F.coalesce("_id", "_new_id").alias("profile_id"), F.coalesce("_new", "_old").alias("_v")).select(*identity, "profile_id", "_v.*")


def parity(rows: DataFrame, by: Sequence[str], left: str, right: str) -> DataFrame:
    """Reachability of two engines and their absolute error in minutes: mean, median, p90, count over 5."""
    a, b = F.col(left), F.col(right)
    error = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) / 60)
    return rows.groupBy(*by).agg(
        F.count_if(a.isNotNull() & b.isNotNull()).alias("both"), F.count_if(a.isNull() & b.isNull()).alias("neither"), F.count_if(a.isNotNull() & b.isNull()).alias("only_left"), F.count_if(a.isNull() & b.isNotNull()).alias("only_right"),
        F.round(F.avg(error), 4).alias("mean_error"), F.round(F.median(error), 4).alias("median_error"), F.round(F.percentile(error, 0.9), 4).alias("p90_error"), F.count_if(error > 5).alias("over_5"),
    )


def period_validation(rows: DataFrame, period: str) -> DataFrame:
    """By service period: the parity of a and b, and the itineraries of b with transfers and with over 15 minutes of walking."""
    routed = rows.where("b is not null").groupBy(period).agg(F.count_if(F.col("transfers") > 0).alias("with_transfers"), F.count_if(F.col("walking") > 900).alias("long_walks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = parity(rows, [period], "a", "b").join(routed, period, "left")
    return both.select(*(c for c in both.columns if c not in ("with_transfers", "long_walks")), zero("with_transfers"), zero("long_walks"))


def contract_gate(pairs: Column, one_sided: Column, p90_error: Column, kept: Column, total: Column) -> Column:
    """accepted, or the first gate that fails: 30 pairs, no one-sided reach, an error of 5 minutes at the 90th percentile, 80 % of cells kept."""
    return F.when(pairs < 30, "too_few_pairs").when(one_sided > 0, "one_sided").when(p90_error > 5, "error_too_large").when(100 * kept < 80 * total, "too_little_coverage").otherwise("accepted")


def work_units(properties: DataFrame, hotspots: Sequence[str], modes: Sequence[str], periods: Sequence[str]) -> DataFrame:
    """Properties by destination and mode, transit also by period; the lists are short and exploded in place."""
    arr = lambda xs: F.array(*map(F.lit, xs))
    rows = properties.withColumn("hotspot_id", F.explode(arr(hotspots))).withColumn("travel_mode", F.explode(arr(modes)))
    period = F.when(F.col("travel_mode") == "transit", arr(periods)).otherwise(F.array(F.lit(None).cast("string")))
    return rows.withColumn("time_period", F.explode(period))


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, all columns, by one max_by."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def leg_breaks(legs: DataFrame, key: str, order: Sequence[str], start: str, end: str) -> DataFrame:
    """(key, legs, breaks): legs that don't begin where the one before ended."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(*order))
    rows = legs.withColumn("_b", before.isNotNull() & (before != F.col(start)))
    return rows.groupBy(key).agg(F.count("*").alias("legs"), F.count_if("_b").alias("breaks"))
