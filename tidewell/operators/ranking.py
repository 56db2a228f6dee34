"""Market baselines and explainable ranking of listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cohort levels from the narrowest to all, with their keys.
LEVELS = (
    ("structure_type_bedrooms_lease", ("rental_structure", "housing_type", "bedrooms", "lease_type")),
    ("structure_type_bedrooms", ("rental_structure", "housing_type", "bedrooms")),
    ("structure_type", ("rental_structure", "housing_type")),
    ("rental_structure", ("rental_structure",)),
    ("relevant_market", ()),
)
# Transit periods and their weights.
PERIOD_WEIGHTS = {
    "weekday_morning_commute": 0.22,
    "weekday_midday": 0.15,
    "weekday_evening_commute": 0.22,
    "weekday_late_evening": 0.18,
    "saturday_daytime": 0.13,
    "sunday_daytime": 0.10,
}


@dataclass(frozen=True)
class RankingConfig:
    """Thresholds and weights; the defaults are the published ones."""

    version: str = "ranking-v1"
    min_cohort: int = 8
    min_price: float = 300.0
    max_price: float = 10000.0
    weights: Mapping[str, float] = field(default_factory=lambda: {"value": 0.45, "campus": 0.35, "transit": 0.20})
    points_per_iqr: float = 20.0
    value_range: tuple[float, float] = (5.0, 95.0)
    walk_weight: float = 0.70
    cycle_weight: float = 0.30
    walk_midpoint: float = 30.0
    cycle_midpoint: float = 12.0
    shape: float = 2.0
    transit_midpoint: float = 30.0
    transit_weights: Sequence[float] = (0.40, 0.30, 0.20, 0.10)
    good_walk_share: float = 0.25
    poor_walk_share: float = 0.75
    transfer_points: float = 30.0
    range_ratio: float = 0.50
    walking_better_score: float = 5.0
    no_route_score: float = 0.0


DEFAULT = RankingConfig()
MARKET_STATUSES = ("active", "relisted")


def market_rows(listings: DataFrame, config: RankingConfig = DEFAULT) -> DataFrame:
    """Listings that may set prices: on the market, plausible price, structure, type and bedrooms known."""
    return listings.where(
        F.col("listing_status").isin(*MARKET_STATUSES)
        & F.col("price_monthly").between(config.min_price, config.max_price)
        & F.col("rental_structure").isNotNull()
        & (F.coalesce("housing_type", F.lit("")) != "")
        & F.col("bedrooms").isNotNull()
    )


def market_cohorts(market: DataFrame) -> DataFrame:
    """Price cohorts of all levels: level, keys, count, p25, median, p75, iqr.

    Prices are first counted by the narrowest key and price, so each cohort's
    exact percentile reads distinct prices with frequencies, not rows.
    """
    keys = LEVELS[0][1]
    counted = market.groupBy(*keys, "price_monthly").agg(F.count("*").alias("n"))
    rows = counted.withColumn("levels", F.array(*(F.struct(F.lit(i).alias("level_no"), F.lit(name).alias("level"), *((F.col(k) if k in own else F.lit(None).cast(dict(market.dtypes)[k])).alias(f"key_{k}") for k in keys)) for i, (name, own) in enumerate(LEVELS))))
    rows = rows.select(F.explode("levels").alias("l"), "price_monthly", "n").select("l.*", "price_monthly", "n")
    group = ["level_no", "level", *(f"key_{k}" for k in keys)]
    by_price = rows.groupBy(*group, "price_monthly").agg(F.sum("n").alias("n"))
    at = lambda p: F.expr(f"percentile(price_monthly, {p}D, n)")
    return by_price.groupBy(*group).agg(F.sum("n").alias("cohort_count"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal in all columns, null to null."""
    test = F.lit(True)
    for x, y in zip(left, right, strict=True):
        test = test & F.col(x).eqNullSafe(F.col(y))
    return test


def select_baselines(market: DataFrame, cohorts: DataFrame, config: RankingConfig = DEFAULT) -> DataFrame:
    """Each market listing with its narrowest cohort that is large enough and not flat, else the widest.

    The level is resolved on the distinct keys, a row per narrowest cohort; the
    listings are joined once, by their full key, null lease included.
    """
    keys = LEVELS[0][1]
    usable = cohorts.where((F.col("level_no") == len(LEVELS) - 1) | ((F.col("cohort_count") >= config.min_cohort) & (F.col("p75") != F.col("p25"))))
    wide = market.select(*keys).distinct()
    levels = F.array(*(F.struct(F.lit(i).alias("_level"), *((F.col(k) if k in own else F.lit(None).cast(dict(market.dtypes)[k])).alias(f"_own_{k}") for k in keys)) for i, (_, own) in enumerate(LEVELS)))
    spread = wide.select(*keys, F.explode(levels).alias("l")).select(*keys, "l.*")
    stats = F.struct("level_no", "level", "cohort_count", "p25", "median", "p75")
    part = usable.select("level_no", *(f"key_{k}" for k in keys), stats.alias("_b"))
    found = spread.join(part, (F.col("_level") == F.col("level_no")) & _same([f"_own_{k}" for k in keys], [f"key_{k}" for k in keys]))
    chosen = found.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.min_by("_b", "_level").alias("baseline"))
    return market.join(chosen, _same(keys, [f"_k_{k}" for k in keys]), "left").drop(*(f"_k_{k}" for k in keys))


def price_percentile(rows: DataFrame, by: Sequence[str], price: str = "price_monthly") -> DataFrame:
    """Adds price_percentile, the price's position in its cohort, 0 to 100; ties share the middle, a lone price is at 50.

    Prices are counted by cohort first, so the window runs over distinct prices
    and the listings are joined once to the places of theirs.
    """
    counted = rows.groupBy(*by, price).agg(F.count("*").alias("_n"))
    cohort = Window.partitionBy(*by)
    less = F.coalesce(F.sum("_n").over(cohort.orderBy(price).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(cohort)
    place = F.when(total == 1, 50.0).otherwise(100.0 * (less + (F.col("_n") - 1) / 2) / (total - 1))
    places = counted.select(*(F.col(c).alias(f"_k_{c}") for c in (*by, price)), place.alias("price_percentile"))
    return rows.join(places, _same([*by, price], [f"_k_{c}" for c in (*by, price)])).drop(*(f"_k_{c}" for c in (*by, price)))


def cohort_percentile(based: DataFrame, market: DataFrame) -> DataFrame:
    """Adds price_percentile: the price's position among all members of the chosen cohort.

    Prices are counted by cohort key and price, so the window runs over
    distinct prices of a cohort and not over its listings.
    """
    keys = LEVELS[0][1]
    levels = F.array(*(F.struct(F.lit(i).alias("level_no"), *((F.col(k).cast("string") if k in own else F.lit(None).cast("string")).alias(f"c_{k}") for k in keys)) for i, (_, own) in enumerate(LEVELS)))
    group = ["level_no", *(f"c_{k}" for k in keys)]
    counted = market.groupBy(*keys, "price_monthly").agg(F.count("*").alias("n"))
    counted = counted.select(F.explode(levels).alias("l"), "price_monthly", "n").select("l.*", "price_monthly", "n").groupBy(*group, "price_monthly").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("price_monthly").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(*group))
    placed = counted.withColumn("price_percentile", F.when(total == 1, 50.0).otherwise(100.0 * (before + (F.col("n") - 1) / 2) / (total - 1)))
    own = based.withColumn("_level", F.col("baseline.level_no"))
    condition = (F.col("_level") == F.col("level_no")) & (F.col("price_monthly") == F.col("_price"))
    placed = placed.withColumnRenamed("price_monthly", "_price").drop("n")
    for k in keys:
        used = F.col("_level").isin([i for i, (_, names) in enumerate(LEVELS) if k in names])
        condition = condition & F.when(used, F.col(k).cast("string")).eqNullSafe(F.col(f"c_{k}"))
    return own.join(placed, condition, "left").drop("_level", "_price", *group)


def value_score(price: Column, median: Column, p25: Column, p75: Column, config: RankingConfig = DEFAULT) -> Column:
    """Robust price score: points per interquartile range from the median, clipped; 50 in a flat cohort."""
    iqr = p75 - p25
    raw = F.when(iqr == 0, 50.0).otherwise(50.0 - config.points_per_iqr * (price - median) / iqr)
    low, high = config.value_range
    return F.when(raw.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), raw)))


def bounded_inverse(value: Column, midpoint: float, shape: float) -> Column:
    """100 / (1 + (max(0, value) / midpoint) ** shape); null stays null, which greatest() alone would turn into 0."""
    return F.when(value.isNotNull(), 100.0 / (1.0 + F.pow(F.greatest(F.lit(0.0), value) / midpoint, F.lit(shape))))


def campus_score(walking_seconds: Column, cycling_seconds: Column, config: RankingConfig = DEFAULT) -> Column:
    walk = bounded_inverse(walking_seconds / 60, config.walk_midpoint, config.shape)
    cycle = bounded_inverse(cycling_seconds / 60, config.cycle_midpoint, config.shape)
    return walk * config.walk_weight + cycle * config.cycle_weight


def transit_period_score(
    duration: Column, walking: Column, transfers: Column, shortest: Column, longest: Column, available: Column, walking_better: Column, no_route: Column, requested: Column, config: RankingConfig = DEFAULT
) -> Column:
    """Evidence-weighted score of a service period: itinerary quality times the share of samples that have one."""
    span = F.greatest(F.lit(1), duration)
    share = F.least(F.lit(1.0), walking / span)
    walk = F.when(walking.isNull(), 0.0).otherwise(100.0 * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - config.good_walk_share) / (config.poor_walk_share - config.good_walk_share)))))
    change = F.greatest(F.lit(0.0), 100.0 - F.coalesce(transfers, F.lit(0)) * config.transfer_points)
    steady = F.when(shortest.isNull() | longest.isNull(), 0.0).otherwise(100.0 * (1 - F.least(F.lit(1.0), (longest - shortest) / span / config.range_ratio)))
    parts = (bounded_inverse(duration / 60, config.transit_midpoint, config.shape), walk, change, steady)
    itinerary = sum((p * w for p, w in zip(parts, config.transit_weights, strict=True)), F.lit(0.0))
    itinerary = F.when(duration.isNotNull() & (available > 0), itinerary).otherwise(0.0)
    return (available * itinerary + walking_better * config.walking_better_score + no_route * config.no_route_score) / F.greatest(F.lit(1), requested)


def ranking_status(complete_access: Column, config: RankingConfig = DEFAULT) -> tuple[Column, Column]:
    """(status, reasons): excluded, partial or ranked."""
    price = F.col("price_monthly")
    excluded = (
        F.when(~F.coalesce(F.col("listing_status").isin(*MARKET_STATUSES), F.lit(False)), "listing_not_active")
        .when(F.col("property_id").isNull(), "missing_property")
        .when(~complete_access, "incomplete_trusted_accessibility")
    )
    missing = F.filter(
        F.array(
            F.when(price.isNull(), "missing_monthly_price").when(~price.between(config.min_price, config.max_price), "implausible_monthly_price"),
            F.when(F.col("bedrooms").isNull(), "missing_bedrooms"),
            F.when(F.coalesce("housing_type", F.lit("")) == "", "missing_housing_type"),
            F.when(F.col("rental_structure").isNull(), "missing_rental_structure"),
        ),
        lambda x: x.isNotNull(),
    )
    status = F.when(excluded.isNotNull(), "excluded").when(F.size(missing) > 0, "partial").otherwise("ranked")
    return status, F.when(excluded.isNotNull(), F.array(excluded)).otherwise(missing)


# Weights of the earlier six-component model.
SIX_WEIGHTS = {"price": 0.30, "distance": 0.25, "amenities": 0.15, "convenience": 0.10, "quality": 0.10, "freshness": 0.10}


def weighted_sum(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Sum of the parts by normalized weights, clipped to 0..100; a missing part counts as zero."""
    whole = sum(weights[name] for name in parts)
    total = sum((F.coalesce(part, F.lit(0.0)) * (weights[name] / whole) for name, part in parts.items()), F.lit(0.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def top_reasons(parts: Mapping[str, Column], n: int = 2) -> Column:
    """Names of the n largest parts, ties by name."""
    entries = F.array(*(F.struct((-F.coalesce(p, F.lit(0.0))).alias("v"), F.lit(name).alias("name")) for name, p in parts.items()))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: e["name"])
