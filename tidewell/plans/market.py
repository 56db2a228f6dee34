"""Market and ranking queries, over parts and orders as listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators.aggregates import distribution
from .frames import frame, load
from .registry import query

_PART = """SELECT p_partkey AS listing_id, p_partkey AS property_id, 'active' AS listing_status, p_retailprice AS price_monthly, p_brand AS rental_structure,
  p_type AS housing_type, CAST(p_size % 5 AS INT) AS bedrooms, CASE p_partkey % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'monthly' END AS lease_type FROM {part}"""


def _parts(spark, sf_dir):
    return spark.sql(_PART, part=load(spark, sf_dir, "part"))


_COHORTS = """m AS (SELECT * FROM l WHERE listing_status IN ('active', 'relisted') AND price_monthly BETWEEN 300 AND 10000 AND rental_structure IS NOT NULL AND coalesce(housing_type, '') <> '' AND bedrooms IS NOT NULL),
e AS (SELECT listing_id, price_monthly, v.level_no, rental_structure AS k1, CASE WHEN v.level_no < 3 THEN housing_type END AS k2, CASE WHEN v.level_no < 2 THEN bedrooms END AS k3, CASE WHEN v.level_no < 1 THEN lease_type END AS k4
  FROM m, (VALUES (0), (1), (2), (3)) v(level_no) UNION ALL SELECT listing_id, price_monthly, 4, NULL, NULL, NULL, NULL FROM m),
c AS (SELECT level_no, k1, k2, k3, k4, count(*) AS n, quantile_cont(price_monthly, 0.25) AS p25, quantile_cont(price_monthly, 0.5) AS median, quantile_cont(price_monthly, 0.75) AS p75 FROM e GROUP BY ALL),
r AS (SELECT e.listing_id, e.price_monthly, c.level_no, c.n, c.p25, c.median, c.p75,
  row_number() OVER (PARTITION BY e.listing_id ORDER BY c.level_no) AS pick, e.less, e.equal
  FROM (SELECT *, rank() OVER (PARTITION BY level_no, k1, k2, k3, k4 ORDER BY price_monthly) - 1 AS less, count(*) OVER (PARTITION BY level_no, k1, k2, k3, k4, price_monthly) AS equal FROM e) e
  JOIN c ON e.level_no = c.level_no AND e.k1 IS NOT DISTINCT FROM c.k1 AND e.k2 IS NOT DISTINCT FROM c.k2 AND e.k3 IS NOT DISTINCT FROM c.k3 AND e.k4 IS NOT DISTINCT FROM c.k4
  WHERE c.level_no = 4 OR (c.n >= 8 AND c.p75 <> c.p25)),
b AS (SELECT *, CASE WHEN n = 1 THEN 50.0 ELSE 100.0 * (less + (equal - 1) / 2.0) / (n - 1) END AS pct,
  greatest(5.0, least(95.0, CASE WHEN p75 = p25 THEN 50.0 ELSE 50.0 - 20.0 * (price_monthly - median) / (p75 - p25) END)) AS score FROM r WHERE pick = 1)"""
_FROM_PART = f"WITH l AS ({_PART.format(part='part')}), {_COHORTS}"
_FROM_LISTINGS = f"WITH l AS (SELECT * FROM listings), {_COHORTS}"


def _based(listings):
    market = R.market_rows(listings)
    based = R.select_baselines(market, R.market_cohorts(market))
    return R.cohort_percentile(based, market)


def ranked_parts(spark, sf_dir):
    """The flagship: parts ranked by robust price score in their narrowest usable cohort."""
    b = F.col("baseline")
    rows = _based(_parts(spark, sf_dir))
    score = R.value_score(F.col("price_monthly"), b.median, b.p25, b.p75)
    return rows.select("listing_id", b.level_no.alias("level_no"), b.cohort_count.alias("cohort_count"), F.round(b.median, 4).alias("median"), F.round(score, 4).alias("value_score"), F.round("price_percentile", 4).alias("price_percentile"))


query("score_value", _FROM_PART + " SELECT listing_id, level_no, n AS cohort_count, round(median, 4) AS median, round(score, 4) AS value_score, round(pct, 4) AS price_percentile FROM b")(ranked_parts)


@query("agg_market_cohorts", _FROM_LISTINGS + " SELECT level_no, k1 AS structure, k2 AS housing_type, k3 AS bedrooms, k4 AS lease_type, n AS cohort_count, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75 FROM c")
def agg_market_cohorts(spark, sf_dir):
    cohorts = R.market_cohorts(R.market_rows(frame(spark, sf_dir, "listings")))
    return cohorts.select("level_no", F.col("key_rental_structure").alias("structure"), F.col("key_housing_type").alias("housing_type"), F.col("key_bedrooms").alias("bedrooms"), F.col("key_lease_type").alias("lease_type"), "cohort_count", *(F.round(c, 4).alias(c) for c in ("p25", "median", "p75")))


@query("agg_baseline_select", _FROM_LISTINGS + " SELECT listing_id, level_no, n AS cohort_count, round(median, 4) AS median FROM b")
def agg_baseline_select(spark, sf_dir):
    market = R.market_rows(frame(spark, sf_dir, "listings"))
    return R.select_baselines(market, R.market_cohorts(market)).select("listing_id", "baseline.level_no", "baseline.cohort_count", F.round("baseline.median", 4).alias("median"))


@query("win_price_percentile", """SELECT listing_id, round(CASE WHEN n = 1 THEN 50.0 ELSE 100.0 * (less + (equal - 1) / 2.0) / (n - 1) END, 4) AS price_percentile FROM (
  SELECT listing_id, count(*) OVER (PARTITION BY housing_type, bedrooms) AS n, rank() OVER (PARTITION BY housing_type, bedrooms ORDER BY price_monthly) - 1 AS less,
  count(*) OVER (PARTITION BY housing_type, bedrooms, price_monthly) AS equal FROM listings WHERE price_monthly IS NOT NULL)""")
def win_price_percentile(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings").where("price_monthly is not null")
    return R.price_percentile(rows, ["housing_type", "bedrooms"]).select("listing_id", F.round("price_percentile", 4).alias("price_percentile"))


@query("filter_market_rows", "SELECT listing_id FROM listings WHERE listing_status IN ('active', 'relisted') AND price_monthly BETWEEN 300 AND 10000 AND rental_structure IS NOT NULL AND coalesce(housing_type, '') <> '' AND bedrooms IS NOT NULL")
def filter_market_rows(spark, sf_dir):
    return R.market_rows(frame(spark, sf_dir, "listings")).select("listing_id")


_STATUS = """CASE WHEN listing_status NOT IN ('active', 'relisted') THEN 'excluded' WHEN property_id IS NULL THEN 'excluded' WHEN NOT location_route_available THEN 'excluded'
  WHEN price_monthly IS NULL OR price_monthly NOT BETWEEN 300 AND 10000 OR bedrooms IS NULL OR coalesce(housing_type, '') = '' OR rental_structure IS NULL THEN 'partial' ELSE 'ranked' END"""


@query("cls_ranking_status", f"""SELECT listing_id, {_STATUS} AS status, CASE WHEN listing_status NOT IN ('active', 'relisted') THEN 'listing_not_active' WHEN NOT location_route_available THEN 'incomplete_trusted_accessibility'
  ELSE concat_ws('|', CASE WHEN price_monthly IS NULL THEN 'missing_monthly_price' WHEN price_monthly NOT BETWEEN 300 AND 10000 THEN 'implausible_monthly_price' END, CASE WHEN bedrooms IS NULL THEN 'missing_bedrooms' END,
  CASE WHEN coalesce(housing_type, '') = '' THEN 'missing_housing_type' END, CASE WHEN rental_structure IS NULL THEN 'missing_rental_structure' END) END AS reasons FROM listings""")
def cls_ranking_status(spark, sf_dir):
    status, reasons = R.ranking_status(F.col("location_route_available"))
    return frame(spark, sf_dir, "listings").select("listing_id", status.alias("status"), F.array_join(reasons, "|").alias("reasons"))


@query("fn_bounded_inverse", "SELECT l_orderkey, l_linenumber, round(100.0 / (1 + pow(greatest(0.0, l_quantity) / 30, 2)), 6) AS score FROM lineitem")
def fn_bounded_inverse(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(R.bounded_inverse(F.col("l_quantity"), 30.0, 2.0), 6).alias("score"))


_ACCESS = """p AS (SELECT property_id, min(CASE WHEN travel_mode = 'walking' THEN representative_duration_seconds END) AS walk, min(CASE WHEN travel_mode = 'cycling' THEN representative_duration_seconds END) AS cycle FROM profiles GROUP BY 1)"""
_CAMPUS = "0.7 * (100.0 / (1 + pow(walk / 60.0 / 30, 2))) + 0.3 * (100.0 / (1 + pow(cycle / 60.0 / 12, 2)))"


def _access(spark, sf_dir):
    seconds = F.col("representative_duration_seconds")
    by_mode = lambda m: F.min(F.when(F.col("travel_mode") == m, seconds))
    return frame(spark, sf_dir, "profiles").groupBy("property_id").agg(by_mode("walking").alias("walk"), by_mode("cycling").alias("cycle"))


@query("score_campus", f"WITH {_ACCESS} SELECT property_id, round({_CAMPUS}, 6) AS campus_score FROM p")
def score_campus(spark, sf_dir):
    return _access(spark, sf_dir).select("property_id", F.round(R.campus_score(F.col("walk"), F.col("cycle")), 6).alias("campus_score"))


_PERIOD = """t AS (SELECT property_id, time_period, count(*) AS requested, count(*) FILTER (WHERE status = 'available') AS available,
  count(*) FILTER (WHERE diagnostic_codes = 'walking_better') AS walking_better, count(*) FILTER (WHERE diagnostic_codes = 'no_route') AS no_route,
  floor(median(duration_seconds) + 0.5) AS d, min(duration_seconds) AS lo, max(duration_seconds) AS hi, min(walking_duration_seconds) AS w, max(transfer_count) AS x FROM samples GROUP BY 1, 2),
s AS (SELECT property_id, time_period, (available * CASE WHEN d IS NOT NULL AND available > 0 THEN
  0.4 * (100.0 / (1 + pow(greatest(0.0, d / 60) / 30, 2))) + 0.3 * (100.0 * (1 - greatest(0.0, least(1.0, (least(1.0, w / greatest(1, d)) - 0.25) / 0.5))))
  + 0.2 * greatest(0.0, 100.0 - x * 30) + 0.1 * (100.0 * (1 - least(1.0, (hi - lo) / greatest(1, d) / 0.5))) ELSE 0.0 END + walking_better * 5.0) / requested AS score FROM t)"""


def _periods(spark, sf_dir):
    s = frame(spark, sf_dir, "samples")
    rows = s.groupBy("property_id", "time_period").agg(
        F.count("*").alias("requested"), F.count_if(F.col("status") == "available").alias("available"), F.count_if(F.col("diagnostic_codes") == "walking_better").alias("walking_better"),
        F.count_if(F.col("diagnostic_codes") == "no_route").alias("no_route"), F.floor(F.median("duration_seconds") + 0.5).alias("d"), F.min("duration_seconds").alias("lo"), F.max("duration_seconds").alias("hi"),
        F.min("walking_duration_seconds").alias("w"), F.max("transfer_count").alias("x"))
    score = R.transit_period_score(*(F.col(c) for c in ("d", "w", "x", "lo", "hi", "available", "walking_better", "no_route", "requested")))
    return rows.withColumn("score", score)


@query("score_transit_period", f"WITH {_PERIOD} SELECT property_id, time_period, round(score, 6) AS score FROM s")
def score_transit_period(spark, sf_dir):
    return _periods(spark, sf_dir).select("property_id", "time_period", F.round("score", 6).alias("score"))


_WEIGHT = "CASE time_period WHEN 'weekday_morning_commute' THEN 0.22 WHEN 'weekday_midday' THEN 0.15 ELSE 0.1 END"


@query("score_transit", f"WITH {_PERIOD} SELECT property_id, round(sum(score * {_WEIGHT}), 5) AS transit_score FROM s GROUP BY 1")
def score_transit(spark, sf_dir):
    weight = F.create_map(*(F.lit(x) for kv in R.PERIOD_WEIGHTS.items() for x in kv))
    return _periods(spark, sf_dir).groupBy("property_id").agg(F.round(F.sum(F.col("score") * F.try_element_at(weight, F.col("time_period"))), 5).alias("transit_score"))


@query("rank_listings", f"""{_FROM_LISTINGS}, {_ACCESS}, g AS (SELECT property_id, {_CAMPUS} AS campus FROM p)
  SELECT l.listing_id, CASE WHEN {_STATUS.replace('location_route_available', '(campus IS NOT NULL)')} = 'ranked' THEN round(0.45 * score + 0.35 * campus + 0.2 * ranking_transit_score, 6) END AS overall_score,
  {_STATUS.replace('location_route_available', '(campus IS NOT NULL)')} AS status FROM l LEFT JOIN g USING (property_id) LEFT JOIN (SELECT listing_id AS lid, score FROM b) b ON lid = l.listing_id""")
def rank_listings(spark, sf_dir):
    listings = frame(spark, sf_dir, "listings")
    campus = _access(spark, sf_dir).select("property_id", R.campus_score(F.col("walk"), F.col("cycle")).alias("campus"))
    b = F.col("baseline")
    value = _based(listings).select("listing_id", R.value_score(F.col("price_monthly"), b.median, b.p25, b.p75).alias("value"))
    rows = listings.join(campus, "property_id", "left").join(value, "listing_id", "left")
    status, _ = R.ranking_status(F.col("campus").isNotNull())
    overall = 0.45 * F.col("value") + 0.35 * F.col("campus") + 0.2 * F.col("ranking_transit_score")
    return rows.select("listing_id", F.when(status == "ranked", F.round(overall, 6)).alias("overall_score"), status.alias("status"))


@query("agg_ranking_summary", "SELECT ranking_status AS status, count(*) AS n, count(*) FILTER (WHERE price_monthly IS NULL) AS missing_price, round(min(ranking_overall_score), 4) AS lowest, round(quantile_cont(ranking_overall_score, 0.5), 4) AS median, round(max(ranking_overall_score), 4) AS highest FROM listings GROUP BY 1")
def agg_ranking_summary(spark, sf_dir):
    s = F.col("ranking_overall_score")
    return frame(spark, sf_dir, "listings").groupBy(F.col("ranking_status").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("price_monthly").isNull()).alias("missing_price"), F.round(F.min(s), 4).alias("lowest"), F.round(F.median(s), 4).alias("median"), F.round(F.max(s), 4).alias("highest"))


@query("agg_legacy_min_max", "SELECT listing_id, round(CASE WHEN price_monthly IS NULL THEN 25.0 WHEN n <= 1 OR hi = lo THEN 60.0 ELSE 100.0 * (hi - price_monthly) / (hi - lo) END, 4) AS price_score FROM (SELECT *, count(price_monthly) OVER w AS n, min(price_monthly) OVER w AS lo, max(price_monthly) OVER w AS hi FROM listings WINDOW w AS (PARTITION BY housing_type, bedrooms))")
def agg_legacy_min_max(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings")
    stats = rows.groupBy("housing_type", "bedrooms").agg(F.count("price_monthly").alias("n"), F.min("price_monthly").alias("lo"), F.max("price_monthly").alias("hi"))
    j = rows.alias("r").join(stats.alias("s"), F.expr("r.housing_type <=> s.housing_type and r.bedrooms <=> s.bedrooms"), "left")
    p = F.col("price_monthly")
    score = F.when(p.isNull(), 25.0).when((F.col("n") <= 1) | (F.col("hi") == F.col("lo")), 60.0).otherwise(100.0 * (F.col("hi") - p) / (F.col("hi") - F.col("lo")))
    return j.select("listing_id", F.round(score, 4).alias("price_score"))


@query("agg_distribution", "SELECT ranking_status, count(ranking_value_score) AS n, round(min(ranking_value_score), 4) AS min, " + ", ".join(f"round(quantile_cont(ranking_value_score, {p}), 4) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) + ", round(max(ranking_value_score), 4) AS max, round(avg(ranking_value_score), 4) AS mean FROM listings GROUP BY 1")
def agg_distribution(spark, sf_dir):
    return distribution(frame(spark, sf_dir, "listings"), ["ranking_status"], "ranking_value_score")


_SIX = """SELECT listing_id, coalesce(CASE WHEN price_monthly IS NULL THEN 25.0 ELSE greatest(0.0, 100 - price_monthly / 100) END, 0) AS price, CASE WHEN distance_km IS NULL THEN 20.0 ELSE greatest(0.0, 100 - 16 * distance_km) END AS distance,
  CASE WHEN amenities IS NULL THEN 0.0 ELSE 25.0 * (length(amenities) - length(replace(amenities, '|', '')) + 1) END AS amenities, coalesce(ranking_transit_score, 0) AS convenience, coalesce(geocode_confidence, 0) * 100 AS quality, CASE WHEN listing_status = 'active' THEN 100.0 ELSE 30.0 END AS freshness FROM listings"""
_SUM = "least(100.0, greatest(0.0, 0.3 * price + 0.25 * distance + 0.15 * amenities + 0.1 * convenience + 0.1 * quality + 0.1 * freshness))"


def _six(spark, sf_dir):
    price = F.col("price_monthly")
    parts = {
        "price": F.when(price.isNull(), 25.0).otherwise(F.greatest(F.lit(0.0), 100 - price / 100)),
        "distance": F.when(F.col("distance_km").isNull(), 20.0).otherwise(F.greatest(F.lit(0.0), 100 - 16 * F.col("distance_km"))),
        "amenities": F.when(F.col("amenities").isNull(), 0.0).otherwise(25.0 * F.size(F.split("amenities", r"\|"))),
        "convenience": F.coalesce("ranking_transit_score", F.lit(0.0)),
        "quality": F.coalesce("geocode_confidence", F.lit(0.0)) * 100,
        "freshness": F.when(F.col("listing_status") == "active", 100.0).otherwise(30.0),
    }
    rows = frame(spark, sf_dir, "listings").select("listing_id", *(p.alias(n) for n, p in parts.items()))
    return rows, {n: F.col(n) for n in parts}


@query("fn_weighted_sum", f"SELECT listing_id, round({_SUM}, 5) AS score FROM ({_SIX})")
def fn_weighted_sum(spark, sf_dir):
    rows, parts = _six(spark, sf_dir)
    return rows.select("listing_id", F.round(R.weighted_sum(parts, R.SIX_WEIGHTS), 5).alias("score"))


@query("rank_listings_weighted", f"""WITH s AS ({_SIX}), u AS (UNPIVOT s ON price, distance, amenities, convenience, quality, freshness INTO NAME part VALUE v),
  t AS (SELECT listing_id, string_agg(part, '|' ORDER BY v DESC, part) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY v DESC, part) AS k FROM u) WHERE k <= 2 GROUP BY 1)
  SELECT listing_id, round({_SUM}, 5) AS score, reasons FROM s JOIN t USING (listing_id)""")
def rank_listings_weighted(spark, sf_dir):
    rows, parts = _six(spark, sf_dir)
    return rows.select("listing_id", F.round(R.weighted_sum(parts, R.SIX_WEIGHTS), 5).alias("score"), F.array_join(R.top_reasons(parts), "|").alias("reasons"))
