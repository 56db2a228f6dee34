"""Accessibility queries, over line items as travel samples and profiles."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import cascade
from ..operators import reuse as R
from ..operators import validation as V
from ..sources.scratch import scratch_path
from ..sources.versions import VersionedTable
from .frames import FRAMES, frame, load
from .registry import query

_VALID = "duration_seconds IS NOT NULL AND status IN ('available', 'estimated')"
_STATS = f"s AS (SELECT property_id, time_period, count(*) AS expected, count(*) FILTER ({_VALID}) AS valid, median(duration_seconds) FILTER ({_VALID}) AS median, min(duration_seconds) FILTER ({_VALID}) AS shortest, max(duration_seconds) FILTER ({_VALID}) AS longest FROM samples GROUP BY 1, 2)"
_REP = f"r AS (SELECT *, row_number() OVER (PARTITION BY property_id, time_period ORDER BY abs(duration_seconds - median), departure_at, sample_id, sample_line, duration_seconds) AS k FROM samples JOIN s USING (property_id, time_period) WHERE {_VALID})"
_BY = ["property_id", "time_period"]


def _profile(spark, sf_dir):
    return A.aggregate_profile(frame(spark, sf_dir, "samples"), _BY)


@query("agg_transit_profile", f"WITH {_STATS}, {_REP} SELECT s.property_id, s.time_period, s.valid, s.median, s.shortest, s.longest, r.duration_seconds AS representative, round(least(1.0, s.valid / s.expected * 0.95), 3) AS confidence FROM s LEFT JOIN r ON r.property_id = s.property_id AND r.time_period = s.time_period AND k = 1")
def agg_transit_profile(spark, sf_dir):
    return _profile(spark, sf_dir).select(*_BY, "valid", "median", "shortest", "longest", "representative", "confidence")


@query("representative_sample", f"WITH {_STATS}, {_REP} SELECT property_id, time_period, departure_at, duration_seconds AS representative FROM r WHERE k = 1")
def representative_sample(spark, sf_dir):
    return _profile(spark, sf_dir).where("representative is not null").select(*_BY, "departure_at", "representative")


@query("fn_int_median", "SELECT property_id, CAST(floor(median(duration_seconds) + 0.5) AS BIGINT) AS seconds FROM samples GROUP BY 1")
def fn_int_median(spark, sf_dir):
    return frame(spark, sf_dir, "samples").groupBy("property_id").agg(A.int_median(F.col("duration_seconds")).alias("seconds"))


@query("agg_sample_outcomes", "SELECT property_id, time_period, count(*) FILTER (status = 'available') AS available, count(*) FILTER (status <> 'available' AND diagnostic_codes = 'no_route') AS no_route, count(*) FILTER (status <> 'available' AND diagnostic_codes = 'walking_better') AS walking_better, count(*) FILTER (status <> 'available' AND coalesce(diagnostic_codes, '') NOT IN ('no_route', 'walking_better')) AS other FROM samples GROUP BY 1, 2")
def agg_sample_outcomes(spark, sf_dir):
    rows = frame(spark, sf_dir, "samples").withColumn("outcome", A.sample_outcome(F.col("diagnostic_codes"), F.col("status")))
    return rows.groupBy(*_BY).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("available", "no_route", "walking_better", "other")))


@query("cls_sample_reusable", "SELECT sample_id, sample_line, property_id, status = 'available' OR (status = 'unavailable' AND coalesce(diagnostic_codes, '') IN ('no_route', 'walking_better')) AS reusable FROM samples")
def cls_sample_reusable(spark, sf_dir):
    return frame(spark, sf_dir, "samples").select("sample_id", "sample_line", "property_id", A.reusable_sample(F.col("diagnostic_codes"), F.col("status")).alias("reusable"))


_ROUTE = "CASE l_linenumber % 2 WHEN 0 THEN 'walking' ELSE 'cycling' END AS mode, CASE WHEN l_linenumber <> 5 THEN CAST(l_quantity * 60 AS INT) END AS duration, l_extendedprice / 10 AS distance, CAST(l_partkey AS DOUBLE) AS straight, CAST(l_suppkey * 3 AS DOUBLE) AS snap"


@query("cls_route_quality", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, {_ROUTE} FROM lineitem), q AS (SELECT *, concat_ws('|', CASE WHEN distance <= 0 OR distance > 100000 THEN 'distance_outlier' END, CASE WHEN duration IS NULL OR duration <= 0 OR duration > 14400 THEN 'duration_outlier' END,
  CASE WHEN straight > 0 AND duration > 0 AND distance / straight > 3.5 THEN 'excessive_detour' END, CASE WHEN duration > 0 AND distance > 0 AND NOT (distance / duration BETWEEN CASE mode WHEN 'walking' THEN 0.4 ELSE 1.5 END AND CASE mode WHEN 'walking' THEN 2.7 ELSE 13.0 END) THEN 'impossible_speed' END, CASE WHEN snap > 200 THEN 'origin_snap_too_far' END) AS reasons FROM r)
  SELECT l_orderkey, l_linenumber, l_partkey, reasons, CASE WHEN duration IS NULL OR duration = 0 THEN 'failed' WHEN regexp_matches(reasons, 'duration_outlier|distance_outlier|impossible_speed|snap') THEN 'manual_review_required' WHEN reasons <> '' THEN 'accepted_with_warning' ELSE 'accepted' END AS decision FROM q""")
def cls_route_quality(spark, sf_dir):
    mode = F.when(F.col("l_linenumber") % 2 == 0, "walking").otherwise("cycling")
    rows = load(spark, sf_dir, "lineitem").withColumns({"mode": mode, "duration": F.when(F.col("l_linenumber") != 5, (F.col("l_quantity") * 60).cast("int")), "distance": F.col("l_extendedprice") / 10})
    reasons = A.route_reasons(F.col("mode"), F.col("duration"), F.col("distance"), F.col("l_partkey").cast("double"), (F.col("l_suppkey") * 3).cast("double"), F.lit(None).cast("double"))
    rows = rows.withColumn("reasons", reasons)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("reasons", "|").alias("reasons"), A.decision(F.col("reasons"), F.coalesce("duration", F.lit(0)) == 0).alias("decision"))


@query("cls_transit_quality", f"WITH {_STATS} SELECT property_id, time_period, CASE WHEN valid = 0 THEN 'no_route' WHEN valid < 100 THEN 'insufficient_samples' WHEN valid < expected THEN 'partial' ELSE 'complete' END AS quality FROM s")
def cls_transit_quality(spark, sf_dir):
    return _profile(spark, sf_dir).select(*_BY, A.transit_quality(F.col("valid"), F.col("expected"), 100).alias("quality"))


_TS = "CASE WHEN is_stale THEN 'stale' WHEN representative_duration_seconds IS NULL THEN 'no_route' WHEN quality_status = 'partial' THEN 'partial' ELSE 'available' END"


def _transport():
    return A.transport_status(F.col("is_stale"), F.col("result_type"), F.col("quality_status"), F.col("representative_duration_seconds"))


@query("cls_transport_status", f"SELECT profile_id, property_id, {_TS} AS status FROM profiles")
def cls_transport_status(spark, sf_dir):
    return frame(spark, sf_dir, "profiles").select("profile_id", "property_id", _transport().alias("status"))


@query("transport_summary", f"""WITH l AS (SELECT *, {_TS} AS status, row_number() OVER (PARTITION BY property_id, travel_mode ORDER BY calculated_at DESC, profile_id DESC) AS k FROM profiles WHERE hotspot_id = 'hub')
  SELECT property_id, max(status) FILTER (travel_mode = 'walking') AS walking, max(status) FILTER (travel_mode = 'cycling') AS cycling, max(status) FILTER (travel_mode = 'transit') AS transit FROM l WHERE k = 1 GROUP BY 1""")
def transport_summary(spark, sf_dir):
    latest = A.newest(frame(spark, sf_dir, "profiles").where("hotspot_id = 'hub'"), ["property_id", "travel_mode"], ["calculated_at", "profile_id"])
    return latest.withColumn("status", _transport()).groupBy("property_id").pivot("travel_mode", ["walking", "cycling", "transit"]).agg(F.max("status"))


@query("join_profile_features", "SELECT property_id, min(representative_duration_seconds) FILTER (travel_mode = 'walking') AS walking, min(representative_duration_seconds) FILTER (travel_mode = 'cycling') AS cycling, min(representative_duration_seconds) FILTER (travel_mode = 'transit') AS transit FROM profiles GROUP BY 1")
def join_profile_features(spark, sf_dir):
    return frame(spark, sf_dir, "profiles").groupBy("property_id").pivot("travel_mode", ["walking", "cycling", "transit"]).agg(F.min("representative_duration_seconds"))


@query("join_lateral_profile", "SELECT p.p_partkey AS property_id, l.profile_id FROM part p LEFT JOIN (SELECT property_id, profile_id, row_number() OVER (PARTITION BY property_id ORDER BY calculated_at DESC, profile_id DESC) AS k FROM profiles WHERE travel_mode = 'cycling' AND NOT is_stale) l ON l.property_id = p.p_partkey AND k = 1")
def join_lateral_profile(spark, sf_dir):
    latest = frame(spark, sf_dir, "profiles").where("travel_mode = 'cycling' and not is_stale").groupBy("property_id").agg(F.max_by("profile_id", F.struct("calculated_at", "profile_id")).alias("profile_id"))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("property_id")).join(latest, "property_id", "left")


@query("fn_expiry", """WITH e AS (SELECT profile_id, property_id, network_version, calculated_at + CASE travel_mode WHEN 'transit' THEN INTERVAL 30 DAY ELSE INTERVAL 180 DAY END AS expires FROM profiles)
  SELECT profile_id, property_id, expires, CASE WHEN expires <= TIMESTAMP '1998-06-01 00:00:00' THEN 'expired' WHEN network_version IS DISTINCT FROM 'n1' THEN 'version_changed' END AS stale_reason FROM e""")
def fn_expiry(spark, sf_dir):
    rows = frame(spark, sf_dir, "profiles").withColumn("expires", A.expiry(F.col("travel_mode"), F.col("calculated_at")))
    return rows.select("profile_id", "property_id", "expires", A.stale_reason(F.col("expires"), F.lit("1998-06-01 00:00:00").cast("timestamp"), F.col("network_version"), "n1").alias("stale_reason"))


#: What is made from what: profiles of properties, surfaces of profiles, scores of surfaces, what is shown of scores.
FRAMES["dependencies"] = """
    SELECT 'property' AS parent_kind, o_custkey AS parent_id, 'profile' AS kind, o_orderkey AS id FROM orders
    UNION ALL SELECT 'profile', l_orderkey, 'surface', l_orderkey * 10 + l_linenumber FROM lineitem
    UNION ALL SELECT 'surface', l_orderkey * 10 + l_linenumber, 'score', l_partkey FROM lineitem WHERE l_quantity > 45
    UNION ALL SELECT 'score', p_partkey, 'visibility', p_partkey FROM part WHERE p_size < 40"""
#: Properties that moved, profiles that expired or are of another network version.
FRAMES["stale_seeds"] = """
    SELECT 'property' AS kind, c_custkey AS id, 'moved' AS reason FROM customer WHERE c_acctbal > 9500
    UNION ALL SELECT 'profile', o_orderkey, 'expired' FROM orders WHERE o_orderdate < TIMESTAMP '1992-03-01 00:00:00'
    UNION ALL SELECT 'profile', o_orderkey, 'version_changed' FROM orders WHERE o_totalprice > 490000"""
_LEVEL = "{0} AS (SELECT id, min({{'depth': depth, 'reason': reason}}) AS s FROM (SELECT id, 0 AS depth, reason FROM stale_seeds WHERE kind = '{0}' UNION ALL SELECT d.id, s.depth + 1, s.reason FROM dependencies d JOIN {1} p ON d.parent_kind = '{1}' AND d.parent_id = p.id WHERE d.kind = '{0}') GROUP BY 1)"
_CASCADE = f"""WITH property AS (SELECT id, min({{'depth': 0, 'reason': reason}}) AS s FROM stale_seeds WHERE kind = 'property' GROUP BY 1), {", ".join(_LEVEL.format(k, p) for p, k in (("property", "profile"), ("profile", "surface"), ("surface", "score"), ("score", "visibility")))}
  SELECT 1 AS run, kind, id, s.reason AS reason, CAST(s.depth AS INT) AS depth FROM ({" UNION ALL ".join(f"SELECT '{k}' AS kind, id, s FROM {k}" for k in ("property", "profile", "surface", "score", "visibility"))})"""


@query("stale_invalidate", _CASCADE)
def stale_invalidate(spark, sf_dir):
    """What goes stale with the seeds, kept in a versioned table; a second run with the same seeds adds nothing."""
    dependencies, seeds = frame(spark, sf_dir, "dependencies"), frame(spark, sf_dir, "stale_seeds")
    table = VersionedTable(spark, scratch_path(spark, "stale"))
    table.append(cascade.invalidate(dependencies, seeds), "run-1", _AT)
    again = cascade.invalidate(dependencies, seeds, table.read())
    return table.read().withColumn("run", F.lit(1)).unionByName(again.withColumn("run", F.lit(2))).select("run", "kind", "id", "reason", "depth")


@query("topk_due_refresh", "SELECT profile_id, property_id, expires_at FROM profiles WHERE is_stale OR expires_at <= TIMESTAMP '1998-06-01 00:00:00' ORDER BY expires_at ASC NULLS FIRST, profile_id, property_id LIMIT 50")
def topk_due_refresh(spark, sf_dir):
    due = F.col("is_stale") | (F.col("expires_at") <= F.lit("1998-06-01 00:00:00").cast("timestamp"))
    return frame(spark, sf_dir, "profiles").where(due).orderBy(F.asc_nulls_first("expires_at"), "profile_id", "property_id").limit(50).select("profile_id", "property_id", "expires_at")


_AT = datetime(1998, 1, 1)
_SAME = ("hotspot_id", "travel_mode", "time_period", "network_version")
_METRES = "CASE WHEN {a}latitude + {a}longitude + {b}latitude + {b}longitude IS NOT NULL THEN 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}latitude - {a}latitude) / 2), 2) + cos(radians({a}latitude)) * cos(radians({b}latitude)) * pow(sin(radians({b}longitude - {a}longitude) / 2), 2)))) END"
_TOGETHER = " AND ".join(f"r.{c} IS NOT DISTINCT FROM f.{c}" for c in _SAME)
_GAP = _METRES.format(a="r.", b="f.")
_STATED = "CASE WHEN coalesce(f.confidence, 0) = 0 THEN 0.7 ELSE f.confidence END"
#: Every request with every compatible profile, and the tier that the profile offers.
_LADDER = f"""
WITH r AS (SELECT q.*, o.latitude, o.longitude, o.nearest_stop_id, o.walking_to_stop_seconds FROM travel_requests q JOIN origins o USING (property_id)),
f AS (SELECT t.*, CASE WHEN NOT unlocated THEN o.latitude + CASE WHEN moved THEN 0.0004e0 ELSE 0e0 END END AS latitude, CASE WHEN NOT unlocated THEN o.longitude END AS longitude, o.nearest_stop_id,
        NOT is_stale AND coalesce(expires_at > TIMESTAMP '1998-01-01 00:00:00', true) AS live FROM travel_profiles t JOIN origins o ON o.property_id = t.origin_id),
c AS (SELECT r.request_id, r.travel_mode, f.property_id IS NOT NULL AND f.property_id = r.property_id AND (r.latitude IS NULL OR coalesce({_GAP} <= 20, false)) AS own, {_GAP} AS gap,
        r.nearest_stop_id = f.nearest_stop_id AND f.to_destination IS NOT NULL AND r.walking_to_stop_seconds IS NOT NULL AS stop, r.walking_to_stop_seconds AS walk,
        f.profile_id, f.duration, f.shortest, f.longest, f.distance, f.walking, f.confidence, {_STATED} AS stated, f.to_destination, f.origin_walk, f.calculated_at, f.live
      FROM r JOIN f ON {_TOGETHER} AND (f.property_id = r.property_id OR r.nearest_stop_id = f.nearest_stop_id OR abs(r.latitude - f.latitude) < 0.002)),
t AS (SELECT *, CASE WHEN live AND own THEN 1 WHEN live AND gap <= 3 THEN 2 WHEN live AND travel_mode = 'transit' AND stop THEN 3
        WHEN live AND travel_mode <> 'transit' AND gap <= 125 THEN 4 WHEN NOT live AND (own OR gap <= 3) THEN 5 END AS tier FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, CASE WHEN tier = 4 THEN gap END, calculated_at DESC, profile_id DESC) AS k FROM t WHERE tier IS NOT NULL),
b AS (SELECT *, CASE travel_mode WHEN 'walking' THEN 4.8 ELSE 15.0 END * 1000 / 3600 AS speed, walk - coalesce(origin_walk, walking, 0) AS longer, ceil(gap * 1.35) AS detour FROM k WHERE k = 1),
z AS (SELECT r.*, {_METRES.format(a="r.", b="h.")} AS straight, CASE r.travel_mode WHEN 'walking' THEN 4.8 WHEN 'cycling' THEN 15.0 END * 1000 / 3600 AS pace FROM r LEFT JOIN hotspots h USING (hotspot_id))
SELECT z.request_id, z.property_id, z.hotspot_id, z.travel_mode, z.time_period, z.network_version,
  CASE tier WHEN 1 THEN 'cached_exact_property' WHEN 2 THEN 'cached_exact_origin' WHEN 3 THEN 'same_stop_reuse' WHEN 4 THEN 'nearby_origin_estimate' WHEN 5 THEN 'stale'
    ELSE CASE WHEN straight IS NULL THEN 'unavailable' WHEN pace IS NULL THEN 'pending_provider' ELSE 'straight_line_estimate' END END AS result_type,
  coalesce(tier IN (3, 4), straight IS NOT NULL AND pace IS NOT NULL) AS is_estimate,
  CASE WHEN tier IN (1, 2, 5) THEN profile_id END AS profile_id, CASE WHEN tier IN (3, 4) THEN profile_id END AS source_profile_id,
  CAST(CASE WHEN tier IS NULL THEN round(straight / pace) WHEN tier = 3 THEN walk + to_destination WHEN tier = 4 THEN duration + ceil(detour / speed) ELSE duration END AS BIGINT) AS duration,
  CAST(CASE tier WHEN 3 THEN CASE WHEN shortest IS NOT NULL THEN greatest(0, shortest + longer) END WHEN 4 THEN shortest + ceil(detour / speed) ELSE shortest END AS BIGINT) AS shortest,
  CAST(CASE tier WHEN 3 THEN CASE WHEN longest IS NOT NULL THEN greatest(0, longest + longer) END WHEN 4 THEN longest + ceil(detour / speed) ELSE longest END AS BIGINT) AS longest,
  CAST(CASE WHEN tier IS NULL THEN CASE WHEN pace IS NOT NULL THEN round(straight) END WHEN tier = 4 THEN distance + detour ELSE distance END AS BIGINT) AS distance,
  CAST(CASE WHEN tier IS NULL THEN CASE WHEN z.travel_mode = 'walking' THEN round(straight / pace) END WHEN tier = 3 THEN walk ELSE walking END AS BIGINT) AS walking,
  CASE WHEN tier IS NULL THEN CASE WHEN straight IS NOT NULL AND pace IS NOT NULL THEN 0.65 END WHEN tier = 3 THEN round(stated * 0.9, 3) WHEN tier = 4 THEN round(stated * 0.85 * (1 - 0.25 * gap / 125), 3) ELSE confidence END AS confidence,
  CASE WHEN tier = 4 THEN gap END AS connector_metres
FROM z LEFT JOIN b USING (request_id)
"""


def _travel(spark, sf_dir):
    """(requests, profiles, destinations) of the ladder; a customer's place is joined by a shuffle, which deals the small file out, before its requests multiply."""
    origins = frame(spark, sf_dir, "origins")
    placed = load(spark, sf_dir, "customer").join(origins.withColumnRenamed("property_id", "c_custkey").hint("shuffle_hash"), "c_custkey")
    text = FRAMES["travel_requests"].replace("SELECT ", "SELECT latitude, longitude, nearest_stop_id, walking_to_stop_seconds, ", 1).replace("FROM customer ", "FROM {placed} ").replace(" JOIN region ", " JOIN {region} ")
    requests = spark.sql(text, placed=placed, region=load(spark, sf_dir, "region"))
    place = origins.select(F.col("property_id").alias("origin_id"), "latitude", "longitude", "nearest_stop_id")
    at = {"latitude": F.when(~F.col("unlocated"), F.col("latitude") + F.when(F.col("moved"), 0.0004).otherwise(0.0)), "longitude": F.when(~F.col("unlocated"), F.col("longitude"))}
    return requests, frame(spark, sf_dir, "travel_profiles").join(place, "origin_id").withColumns(at), frame(spark, sf_dir, "hotspots")


@query("access_reuse_ladder", _LADDER)
def access_reuse_ladder(spark, sf_dir):
    return R.resolve_access(*_travel(spark, sf_dir), _AT, _SAME)


@query("sink_reuse_audit", f"SELECT attempt, status, result_type, is_estimate, count(*) AS n FROM ({_LADDER}) JOIN (VALUES (1, 'appended', false), (2, 'already_imported', false), (3, 'appended', true), (4, 'already_imported', true)) v(attempt, status, transit) ON v.transit OR travel_mode <> 'transit' GROUP BY ALL")
def sink_reuse_audit(spark, sf_dir):
    """The ladder's answers appended to a history, a run for direct modes and one for transit, each sent twice; the history by tier after each.

    A run answers its own requests, from profiles of their modes, while it is staged: the answers are written once, as history.
    """
    requests, profiles, destinations = _travel(spark, sf_dir)
    direct, transit = (R.resolve_access(requests.where(test), profiles.where(test), destinations, _AT, _SAME, by) for test, by in (("travel_mode <> 'transit'", False), ("travel_mode = 'transit'", True)))
    table = VersionedTable(spark, scratch_path(spark, "audit"))
    seen = []
    for attempt, (rows, run, day) in enumerate(((direct, "direct", 1), (direct, "direct", 1), (transit, "transit", 2), (direct, "direct", 3)), 1):
        status, commit = table.append(rows.withColumn("run_id", F.lit(run)), run, _AT.replace(day=day))
        seen.append(table.read(commit).groupBy("result_type", "is_estimate").agg(F.count("*").alias("n")).select(F.lit(attempt).alias("attempt"), F.lit(status).alias("status"), "*"))
    return reduce(DataFrame.unionByName, seen)


@query("upsert_profile_identity", """WITH o AS (SELECT property_id, travel_mode, min(profile_id) AS profile_id, max(representative_duration_seconds) AS d FROM profiles WHERE calculated_at < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2), n AS (SELECT property_id, travel_mode, min(profile_id) AS profile_id, max(representative_duration_seconds) AS d FROM profiles WHERE calculated_at >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2)
  SELECT coalesce(o.property_id, n.property_id) AS property_id, coalesce(o.travel_mode, n.travel_mode) AS travel_mode, coalesce(o.profile_id, n.profile_id) AS profile_id, CASE WHEN n.property_id IS NOT NULL THEN n.d ELSE o.d END AS d FROM o FULL JOIN n ON o.property_id = n.property_id AND o.travel_mode = n.travel_mode""")
def upsert_profile_identity(spark, sf_dir):
    rows = frame(spark, sf_dir, "profiles")
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp")
    half = lambda test: rows.where(test).groupBy("property_id", "travel_mode").agg(F.min("profile_id").alias("profile_id"), F.max("representative_duration_seconds").alias("d"))
    return A.profile_upsert(half(F.col("calculated_at") < cut), half(F.col("calculated_at") >= cut), ["property_id", "travel_mode"], ["d"])


_PAIRS = "SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'walking' WHEN 1 THEN 'cycling' ELSE 'transit' END AS mode, CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_quantity * 60 AS INT) END AS a, CASE WHEN l_suppkey % 7 <> 0 THEN CAST(l_quantity * 60 + l_partkey % 500 AS INT) END AS b, CAST(l_partkey % 700 AS DOUBLE) AS snap, CAST(l_orderkey % 4 AS INT) AS transfers, CAST(l_quantity * 20 AS INT) AS walking FROM lineitem"


def _pairs(spark, sf_dir):
    return spark.sql(_PAIRS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=load(spark, sf_dir, "lineitem"))


_PARITY = "count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (a IS NULL AND b IS NULL) AS neither, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_left, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_right, round(avg(abs(a - b) / 60.0), 4) AS mean_error, round(median(abs(a - b) / 60.0::DOUBLE), 4) AS median_error, round(quantile_cont(abs(a - b) / 60.0::DOUBLE, 0.9), 4) AS p90_error, count(*) FILTER (abs(a - b) > 300) AS over_5"


@query("agg_parity_confusion", f"SELECT mode, {_PARITY} FROM ({_PAIRS}) GROUP BY 1")
def agg_parity_confusion(spark, sf_dir):
    return A.parity(_pairs(spark, sf_dir), ["mode"], "a", "b")


@query("agg_period_validation", f"SELECT CAST(l_orderkey % 6 AS BIGINT) AS period, {_PARITY}, count(*) FILTER (b IS NOT NULL AND transfers > 0) AS with_transfers, count(*) FILTER (b IS NOT NULL AND walking > 900) AS long_walks FROM ({_PAIRS}) GROUP BY 1")
def agg_period_validation(spark, sf_dir):
    return A.period_validation(_pairs(spark, sf_dir).withColumn("period", F.col("l_orderkey") % 6), "period")


@query("agg_correlation", f"SELECT mode, round(corr(snap, abs(a - b)), 6) AS r FROM ({_PAIRS}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def agg_correlation(spark, sf_dir):
    rows = _pairs(spark, sf_dir).where("a is not null and b is not null")
    return rows.groupBy("mode").agg(F.round(F.corr("snap", F.abs(F.col("a") - F.col("b")).cast("double")), 6).alias("r"))


_SWEEP = f"SELECT mode, t AS threshold, count(*) AS kept, {_PARITY} FROM ({_PAIRS}), (VALUES (100), (150), (200), (250), (400), (600)) v(t) WHERE snap <= t GROUP BY 1, 2"


def _sweep(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in (100, 150, 200, 250, 400, 600))))).where("snap <= threshold")
    kept = rows.groupBy("mode", "threshold").agg(F.count("*").alias("kept"))
    return A.parity(rows, ["mode", "threshold"], "a", "b").join(kept, ["mode", "threshold"])


query("agg_threshold_sweep", _SWEEP)(_sweep)


@query("cls_contract_gate", f"SELECT mode, threshold, CASE WHEN both_n < 30 THEN 'too_few_pairs' WHEN only_left + only_right > 0 THEN 'one_sided' WHEN p90_error > 5 THEN 'error_too_large' WHEN 100 * kept < 80 * total THEN 'too_little_coverage' ELSE 'accepted' END AS gate FROM (SELECT *, \"both\" AS both_n FROM ({_SWEEP})) JOIN (SELECT mode, count(*) AS total FROM ({_PAIRS}) GROUP BY 1) USING (mode)")
def cls_contract_gate(spark, sf_dir):
    totals = _pairs(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("total"))
    rows = _sweep(spark, sf_dir).join(totals, "mode")
    return rows.select("mode", "threshold", A.contract_gate(F.col("both"), F.col("only_left") + F.col("only_right"), F.col("p90_error"), F.col("kept"), F.col("total")).alias("gate"))


@query("join_cross_workunits", "SELECT p_partkey AS property_id, h AS hotspot_id, m AS travel_mode, t AS time_period FROM part, (VALUES ('hub'), ('mall')) a(h), (VALUES ('walking', NULL), ('cycling', NULL), ('transit', 'am'), ('transit', 'pm')) b(m, t)")
def join_cross_workunits(spark, sf_dir):
    return A.work_units(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("property_id")), ["hub", "mall"], ["walking", "cycling", "transit"], ["am", "pm"])


@query("work_estimate", "WITH c AS (SELECT DISTINCT property_id, travel_mode FROM profiles WHERE NOT is_stale) SELECT m AS travel_mode, count(*) AS units, count(c.property_id) AS hits, count(*) - count(c.property_id) AS calls FROM part CROSS JOIN (VALUES ('walking'), ('cycling'), ('transit')) b(m) LEFT JOIN c ON c.property_id = p_partkey AND c.travel_mode = m GROUP BY 1")
def work_estimate(spark, sf_dir):
    units = A.work_units(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("property_id")), ["hub"], ["walking", "cycling", "transit"], ["am"])
    cached = frame(spark, sf_dir, "profiles").where("not is_stale").select("property_id", "travel_mode").distinct().withColumn("hit", F.lit(1))
    rows = units.join(cached, ["property_id", "travel_mode"], "left")
    return rows.groupBy("travel_mode").agg(F.count("*").alias("units"), F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("calls"))


@query("join_sample_gap_fill", "WITH w AS (SELECT DISTINCT property_id, departure_at FROM samples), c AS (SELECT property_id, departure_at, min(duration_seconds) AS cached FROM samples WHERE status = 'available' GROUP BY 1, 2) SELECT property_id, count(*) AS wanted, count(cached) AS cached, count(*) - count(cached) AS fetched FROM w LEFT JOIN c USING (property_id, departure_at) GROUP BY 1")
def join_sample_gap_fill(spark, sf_dir):
    rows = frame(spark, sf_dir, "samples")
    cached = rows.where("status = 'available'").groupBy("property_id", "departure_at").agg(F.min("duration_seconds").alias("cached"))
    wanted = rows.select("property_id", "departure_at").distinct().join(cached, ["property_id", "departure_at"], "left")
    return wanted.groupBy("property_id").agg(F.count("*").alias("wanted"), F.count("cached").alias("cached"), (F.count("*") - F.count("cached")).alias("fetched"))


@query("agg_batch_rollup", "SELECT CAST(l_suppkey % 10 AS BIGINT) AS batch, CAST(sum(l_linenumber) AS BIGINT) AS calls, count(*) FILTER (l_returnflag = 'R') AS errors, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def agg_batch_rollup(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("batch")).agg(F.sum("l_linenumber").alias("calls"), F.count_if(F.col("l_returnflag") == "R").alias("errors"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("batch_quality_report", "WITH q AS (SELECT CAST(property_id % 10 AS BIGINT) AS batch, quality_status, is_stale FROM profiles) SELECT batch, count(*) AS n, count(*) FILTER (quality_status = 'partial') AS warnings, count(*) FILTER (is_stale) AS review FROM q GROUP BY 1")
def batch_quality_report(spark, sf_dir):
    rows = frame(spark, sf_dir, "profiles").withColumn("batch", F.col("property_id") % 10)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("quality_status") == "partial").alias("warnings"), F.count_if("is_stale").alias("review"))


FRAMES["legs"] = """
    SELECT l_orderkey AS route, l_linenumber AS leg, l_partkey AS tie, l_suppkey AS from_stop, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey ELSE l_partkey % 100 END AS to_stop, CAST(l_linenumber * 600 + l_quantity * 3 AS BIGINT) AS departs,
      CAST(l_linenumber * 600 + l_quantity * 3 + (l_partkey + l_orderkey) % 650 - 5 AS BIGINT) AS arrives, l_discount AS from_offset, l_discount + l_tax AS to_offset FROM lineitem"""
FRAMES["leg_profiles"] = "SELECT o_orderkey AS route, CAST(floor(o_totalprice) AS BIGINT) % 1200 AS duration FROM orders WHERE o_orderkey % 9 <> 0"


@query("route_audit", """WITH b AS (SELECT *, lag(to_stop) OVER w AS stop, lag(arrives) OVER w AS arrived FROM legs WINDOW w AS (PARTITION BY route ORDER BY leg, tie, from_stop)),
  g AS (SELECT route, count(*) AS legs, bool_or(stop <> from_stop) AS a, bool_or(to_offset <= from_offset) AS o, bool_or(arrives < departs) AS t, bool_or(departs < arrived) AS d, max(arrives) - min(departs) AS took FROM b GROUP BY 1)
  SELECT g.route, legs, concat_ws('|', CASE WHEN a THEN 'leg_break' END, CASE WHEN o THEN 'offset_falls' END, CASE WHEN t THEN 'arrives_before_departs' END, CASE WHEN d THEN 'departs_before_arrival' END, CASE WHEN took <> duration THEN 'duration_differs' END, CASE WHEN duration IS NULL THEN 'no_profile' END) AS violations,
    took - duration AS gap_seconds FROM g LEFT JOIN leg_profiles p ON p.route = g.route""")
def route_audit(spark, sf_dir):
    out = V.leg_violations(frame(spark, sf_dir, "legs"), "route", ["leg", "tie", "from_stop"], frame(spark, sf_dir, "leg_profiles"))
    return out.withColumn("violations", F.array_join("violations", "|"))


@query("itinerary_summary", "SELECT l_orderkey AS route, CAST(sum(l_quantity) FILTER (l_returnflag = 'A') AS BIGINT) AS walk, CAST(sum(l_quantity) FILTER (l_returnflag <> 'A') AS BIGINT) AS ride, greatest(count(*) FILTER (l_returnflag <> 'A') - 1, 0) AS transfers FROM lineitem GROUP BY 1")
def itinerary_summary(spark, sf_dir):
    legs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("s"))).alias("legs"))
    total = lambda test: F.aggregate(F.filter("legs", test), F.lit(0.0), lambda a, x: a + x.s)
    walk, ride = F.filter("legs", lambda x: x.mode == "A"), F.filter("legs", lambda x: x.mode != "A")
    return legs.select("route", F.when(F.size(walk) > 0, total(lambda x: x.mode == "A")).cast("long").alias("walk"), F.when(F.size(ride) > 0, total(lambda x: x.mode != "A")).cast("long").alias("ride"), F.greatest(F.size(ride) - 1, F.lit(0)).cast("long").alias("transfers"))


@query("validation_points", "WITH m AS (SELECT property_id, max(representative_duration_seconds) AS farthest, count(*) FILTER (representative_duration_seconds IS NULL) AS unreachable FROM profiles GROUP BY 1) SELECT property_id, farthest, unreachable > 0 AS has_unreachable FROM m")
def validation_points(spark, sf_dir):
    return frame(spark, sf_dir, "profiles").groupBy("property_id").agg(F.max("representative_duration_seconds").alias("farthest"), F.bool_or(F.col("representative_duration_seconds").isNull()).alias("has_unreachable"))


@query("mobility_summary", "SELECT travel_mode, count(*) AS n, count(*) FILTER (representative_duration_seconds IS NULL) AS unavailable, min(representative_duration_seconds) AS shortest, round(quantile_cont(representative_duration_seconds::DOUBLE, 0.5), 4) AS median, max(representative_duration_seconds) AS longest FROM profiles GROUP BY 1")
def mobility_summary(spark, sf_dir):
    d = F.col("representative_duration_seconds")
    return frame(spark, sf_dir, "profiles").groupBy("travel_mode").agg(F.count("*").alias("n"), F.count_if(d.isNull()).alias("unavailable"), F.min(d).alias("shortest"), F.round(F.median(d), 4).alias("median"), F.max(d).alias("longest"))


@query("topk_extremes", "SELECT travel_mode, profile_id, property_id, side FROM (SELECT travel_mode, profile_id, property_id, 'low' AS side, row_number() OVER (PARTITION BY travel_mode ORDER BY representative_duration_seconds, profile_id, property_id) AS k FROM profiles WHERE representative_duration_seconds IS NOT NULL UNION ALL SELECT travel_mode, profile_id, property_id, 'high', row_number() OVER (PARTITION BY travel_mode ORDER BY representative_duration_seconds DESC, profile_id, property_id) FROM profiles WHERE representative_duration_seconds IS NOT NULL) WHERE k <= 5")
def topk_extremes(spark, sf_dir):
    from ..operators.sorts import top_per_key

    rows = frame(spark, sf_dir, "profiles").where("representative_duration_seconds is not null")
    d = "representative_duration_seconds"
    ends = [top_per_key(rows, ["travel_mode"], [order, F.col("profile_id"), F.col("property_id")], 5).withColumn("side", F.lit(side)) for side, order in (("low", F.asc(d)), ("high", F.desc(d)))]
    return ends[0].unionByName(ends[1]).select("travel_mode", "profile_id", "property_id", "side")


@query("agg_histogram_buckets", "SELECT travel_mode, CASE WHEN m >= 40 THEN '40+' WHEN m >= 20 THEN '20-40' WHEN m >= 10 THEN '10-20' WHEN m >= 5 THEN '5-10' WHEN m >= 0 THEN '0-5' END AS bucket, count(*) AS n FROM (SELECT travel_mode, representative_duration_seconds / 60.0 AS m FROM profiles) GROUP BY 1, 2")
def agg_histogram_buckets(spark, sf_dir):
    from ..operators.aggregates import bucket_label

    rows = frame(spark, sf_dir, "profiles").withColumn("bucket", bucket_label(F.col("representative_duration_seconds") / 60, (0, 5, 10, 20, 40)))
    return rows.groupBy("travel_mode", "bucket").agg(F.count("*").alias("n"))
