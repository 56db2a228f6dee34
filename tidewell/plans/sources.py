"""Sources and sinks: tables written in the artifact formats and read back."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import text as X
from ..operators import lifecycle as L
from ..sources import gtfs
from ..sources import readers as S
from ..sources.scratch import scratch_path, stored
from ..sources.versions import OutOfOrderRun, VersionedTable
from .frames import FRAMES, frame, load
from .registry import query


def _csv(spark, rows, name):
    path = scratch_path(spark, name)
    S.write_csv(rows, path, rows.columns)
    return path


@query("scan_csv_strings", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def scan_csv_strings(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("﻿p_partkey"), "p_name", "p_brand", "p_size")
    return S.read_csv_strings(spark, _csv(spark, rows, "parts"))


@query("sink_csv_ordered", "SELECT p_brand, p_name, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")
def sink_csv_ordered(spark, sf_dir):
    path = scratch_path(spark, "ordered")
    S.write_csv(load(spark, sf_dir, "part"), path, ["p_brand", "p_name", "p_partkey"])
    return S.read_csv_strings(spark, path)


_FIELD = "CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' WHEN 3 THEN '' END"


@query("scan_csv_typed", f"SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS INT) END AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'a;b' ELSE 'c;d' END AS items FROM orders")
def scan_csv_typed(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 5 == 0, "Yes").when(k % 5 == 1, "no").when(k % 5 == 2, "maybe").when(k % 5 == 3, "").alias("flag"),
        F.when(k % 3 == 0, "n/a").when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string")).alias("number"), F.when(k % 2 == 0, '["b", "a"]').otherwise("d|c|d").alias("items"))
    found = S.typed(S.read_csv_strings(spark, _csv(spark, rows, "typed")), {"flag": "bool", "number": "int", "items": "list"})
    return found.select(F.col("id").cast("long").alias("id"), "flag", "number", F.array_join("items", ";").alias("items"))


#: A feed: suppliers as stops, nations as routes, orders as trips, line items as their times.
FRAMES["gtfs_stops"] = "SELECT concat('p', CAST(s_suppkey AS STRING)) AS stop_id, s_name AS stop_name, CASE WHEN s_suppkey % 7 = 0 THEN '?' ELSE CAST(42 + s_suppkey % 100 / 100e0 AS STRING) END AS stop_lat, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(-81 - s_suppkey % 50 / 100e0 AS STRING) ELSE '-999' END AS stop_lon FROM supplier WHERE s_suppkey % 13 <> 0"
FRAMES["gtfs_routes"] = "SELECT concat('r', CAST(n_nationkey AS STRING)) AS route_id, substr(n_name, 1, 3) AS route_short_name, n_name AS route_long_name FROM nation"
FRAMES["gtfs_trips"] = "SELECT concat('t', CAST(o_orderkey AS STRING)) AS trip_id, concat('r', CAST(o_custkey % 27 AS STRING)) AS route_id, concat('s', CAST(o_orderkey % 7 AS STRING)) AS service_id FROM orders WHERE o_orderkey % 19 <> 0"
_CLOCK = "concat(lpad(CAST(CAST(floor(m / 60) AS BIGINT) AS STRING), 2, '0'), ':', lpad(CAST(m % 60 AS STRING), 2, '0'), ':00')"
FRAMES["gtfs_times"] = f"""SELECT trip_id, stop_id, stop_sequence, CASE WHEN m % 41 = 0 THEN 'late' ELSE {_CLOCK} END AS arrival_time, CASE WHEN m % 41 <> 0 AND m % 5 = 0 THEN {_CLOCK} END AS departure_time FROM (
    SELECT concat('t', CAST(l_orderkey AS STRING)) AS trip_id, concat('p', CAST(l_suppkey AS STRING)) AS stop_id, CAST(l_linenumber AS STRING) AS stop_sequence, l_orderkey % 1500 + l_linenumber * CASE WHEN l_orderkey % 23 = 0 THEN -3 ELSE 4 END + 30 AS m FROM lineitem)"""
_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
FRAMES["gtfs_calendar"] = f"SELECT concat('s', CAST(r_regionkey AS STRING)) AS service_id, {', '.join(f'CASE WHEN r_regionkey IN (1, 4) THEN CASE WHEN r_regionkey = {4 if i > 4 else 1} THEN 1 ELSE 0 END ELSE CASE WHEN r_regionkey = 0 THEN 1 ELSE 0 END END AS {d}' for i, d in enumerate(_DAYS))}, CASE r_regionkey WHEN 3 THEN '2026-01-01' ELSE '20260101' END AS start_date, CASE r_regionkey WHEN 2 THEN '20251231' ELSE '20260630' END AS end_date FROM region"
FRAMES["gtfs_dates"] = "SELECT concat('s', CAST(r_regionkey + 3 AS STRING)) AS service_id, CASE r_regionkey WHEN 1 THEN '20260105' ELSE '20260704' END AS date, CASE WHEN r_regionkey < 3 THEN '1' ELSE '2' END AS exception_type FROM region"
_FEED = {"stops": "gtfs_stops", "routes": "gtfs_routes", "trips": "gtfs_trips", "stop_times": "gtfs_times", "calendar": "gtfs_calendar", "calendar_dates": "gtfs_dates"}


def _feed(spark, sf_dir):
    """The feed written as its files and read back."""
    return gtfs.read_feed(spark, {name: _csv(spark, frame(spark, sf_dir, role), name) for name, role in _FEED.items()})


_SECONDS = "CAST(split_part({0}, ':', 1) AS INT) * 3600 + CAST(split_part({0}, ':', 2) AS INT) * 60"
_TIMED = f"SELECT trip_id, stop_id, CAST(stop_sequence AS INT) AS stop_sequence, CASE WHEN arrival_time <> 'late' THEN {_SECONDS.format('arrival_time')} END AS arrival, CASE WHEN departure_time IS NOT NULL THEN {_SECONDS.format('departure_time')} END AS departure FROM gtfs_times"
_PLACED = "SELECT stop_id FROM gtfs_stops WHERE stop_lat <> '?' AND stop_lon <> '-999'"


@query("scan_gtfs", f"""SELECT r.route_id, count(DISTINCT t.trip_id) AS trips, count(*) AS stop_times, count(DISTINCT p.stop_id) AS stops, min(departure) AS first_departure, max(arrival) AS last_arrival, count(*) FILTER (coalesce(arrival, departure) >= 86400) AS past_midnight
  FROM ({_TIMED}) x JOIN gtfs_trips t ON t.trip_id = x.trip_id JOIN gtfs_routes r ON r.route_id = t.route_id LEFT JOIN ({_PLACED}) p ON p.stop_id = x.stop_id GROUP BY 1""")
def scan_gtfs(spark, sf_dir):
    return gtfs.route_summary(_feed(spark, sf_dir))


_SERVICES = "SELECT service_id FROM gtfs_calendar UNION SELECT service_id FROM gtfs_dates WHERE exception_type = '1'"
_FALLS = f"SELECT trip_id FROM (SELECT trip_id, t, lag(t) OVER (PARTITION BY trip_id ORDER BY stop_sequence, arrival, departure, k) AS before FROM (SELECT trip_id, stop_sequence, arrival, departure, unnest([1, 2]) AS k, unnest([arrival, departure]) AS t FROM ({_TIMED})) WHERE t IS NOT NULL) WHERE t < before GROUP BY 1"
_AUDIT = {
    "trip_without_route": "FROM gtfs_trips WHERE route_id NOT IN (SELECT route_id FROM gtfs_routes)", "trip_without_service": f"FROM gtfs_trips WHERE service_id NOT IN ({_SERVICES})", "time_without_trip": "FROM gtfs_times WHERE trip_id NOT IN (SELECT trip_id FROM gtfs_trips)",
    "time_without_stop": "FROM gtfs_times WHERE stop_id NOT IN (SELECT stop_id FROM gtfs_stops)", "trip_without_times": "FROM gtfs_trips WHERE trip_id NOT IN (SELECT trip_id FROM gtfs_times)", "stop_without_place": f"FROM gtfs_stops WHERE stop_id NOT IN ({_PLACED})",
    "stop_id_repeats": "FROM (SELECT stop_id FROM gtfs_stops GROUP BY 1 HAVING count(*) > 1)", "trip_id_repeats": "FROM (SELECT trip_id FROM gtfs_trips GROUP BY 1 HAVING count(*) > 1)", "route_id_repeats": "FROM (SELECT route_id FROM gtfs_routes GROUP BY 1 HAVING count(*) > 1)",
    "sequence_repeats": "FROM (SELECT trip_id FROM gtfs_times GROUP BY trip_id, stop_sequence HAVING count(*) > 1)", "time_not_read": "FROM gtfs_times WHERE arrival_time = 'late' AND departure_time IS NULL", "times_fall": f"FROM ({_FALLS})",
    "short_trip": "FROM (SELECT trip_id FROM gtfs_times GROUP BY 1 HAVING count(*) < 2)", "service_never_runs": "FROM gtfs_calendar WHERE service_id = 's2'", "service_dates_not_read": "FROM gtfs_calendar WHERE length(start_date) <> 8",
}

_LATE = f"SELECT trip_id FROM ({_TIMED}) WHERE greatest(arrival, departure) >= 86400"
_DATES = "(SELECT unnest([start_date, end_date]) AS d FROM gtfs_calendar) WHERE length(d) = 8"
_FACTS = {
    "stops": ("count(*)", "FROM gtfs_stops"), "routes": ("count(*)", "FROM gtfs_routes"), "trips": ("count(*)", "FROM gtfs_trips"), "stop_times": ("count(*)", "FROM gtfs_times"), "times_past_midnight": ("count(*)", f"FROM ({_LATE})"),
    "latest_clock": ("max(greatest(nullif(arrival_time, 'late'), departure_time))", "FROM gtfs_times"), "calendar_first_day": ("CAST(strptime(min(d), '%Y%m%d') AS DATE)", f"FROM {_DATES}"), "calendar_last_day": ("CAST(strptime(max(d), '%Y%m%d') AS DATE)", f"FROM {_DATES}"),
    "day_in_calendar": ("min(d) <= '20260105' AND max(d) >= '20260105'", f"FROM {_DATES}"), "service_on_day": ("service_id", "FROM gtfs_calendar WHERE monday = 1 AND start_date <= '20260105' AND end_date >= '20260105' AND length(start_date) = 8"),
    "trip_past_midnight": ("trip_id", f"FROM ({_LATE}) GROUP BY trip_id"), "route_past_midnight": ("route_id", f"FROM gtfs_trips WHERE trip_id IN ({_LATE}) GROUP BY route_id"),
}


@query("agg_gtfs_audit", " UNION ALL ".join(f"SELECT '{name}' AS \"check\", CAST(count(*) AS VARCHAR) AS found {rest}" for name, rest in _AUDIT.items()) + """
  UNION ALL SELECT * FROM (VALUES ('first_day', '2026-01-01'), ('last_day', '2026-07-04'), ('days_left', '180'), ('weekdays', 'monday|tuesday|wednesday|thursday|friday|saturday|sunday'), ('services', '3'), ('status', 'current')) v(a, b)
  UNION ALL SELECT 'trips_today', CAST(count(*) AS VARCHAR) FROM gtfs_trips WHERE service_id IN ('s0', 's1', 's4')
  UNION ALL """ + " UNION ALL ".join(f"SELECT '{name}', CAST({value} AS VARCHAR) {rest}" for name, (value, rest) in _FACTS.items()))
def agg_gtfs_audit(spark, sf_dir):
    """The feed's checks, its span and service on a Monday, and the facts of the audit: counts, services, times past midnight with their trips and routes."""
    feed, today = _feed(spark, sf_dir), F.lit("2026-01-05").cast("date")
    timed = stored(gtfs.times_by_trip(feed))
    span = gtfs.feed_span(feed, today)
    names = span.columns
    flat = span.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).cast("string").alias("found")) for n in names))).alias("s")).select("s.*")
    facts = gtfs.feed_facts(feed, today, timed).toDF("check", "found")
    return gtfs.feed_checks(feed, timed).select("check", F.col("n").cast("string").alias("found")).unionByName(flat).unionByName(facts)


@query("scan_feature_snapshot", "SELECT 'nation-' || CAST(c_nationkey AS VARCHAR) AS dataset, c_custkey AS id, c_mktsegment AS segment FROM customer")
def scan_feature_snapshot(spark, sf_dir):
    feature = F.struct(F.col("c_custkey").alias("id"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attributes"))
    docs = load(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 100)).agg(F.collect_list(feature).alias("features"))
    path = scratch_path(spark, "snapshot")
    docs.select(F.struct(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("dataset")).alias("metadata"), "features").write.json(path)
    return S.read_snapshot(spark, path).select("dataset", "id", F.try_element_at("attributes", F.lit("segment")).alias("segment"))


@query("scan_profiles_nested", "SELECT property_id, travel_mode, count(*) AS samples, CAST(sum(representative_duration_seconds) AS BIGINT) AS seconds FROM profiles GROUP BY 1, 2")
def scan_profiles_nested(spark, sf_dir):
    rows = frame(spark, sf_dir, "profiles")
    sample = F.struct(F.col("calculated_at").cast("string").alias("departure_at"), F.col("representative_duration_seconds").alias("duration_seconds"))
    one = rows.groupBy("property_id", "travel_mode").agg(F.min("profile_id").alias("profile_id"), F.collect_list(sample).alias("samples"))
    path = scratch_path(spark, "profiles")
    one.groupBy("property_id").agg(F.collect_list(F.struct("profile_id", "travel_mode", "samples")).alias("profiles")).write.json(path)
    return S.read_profiles(spark, path).groupBy("property_id", "travel_mode").agg(F.count("*").alias("samples"), F.sum("duration_seconds").alias("seconds"))


@query("scan_decision_log", "SELECT event_type AS action, count(*) AS n, count(*) FILTER (event_id % 50 = 0) AS broken FROM events GROUP BY 1")
def scan_decision_log(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("event_id").alias("decision_id"), F.col("user_id").alias("listing_id"), F.col("event_type").alias("action"), F.col("ts").cast("string").alias("created_at")))
    path = scratch_path(spark, "log")
    e.select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), F.col("event_type"))).otherwise(good).alias("value")).write.text(path)
    decisions, broken = S.read_decisions(spark, path)
    bad = broken.select(F.regexp_extract("line", r"broken (\w+)", 1).alias("action")).groupBy("action").agg(F.count("*").alias("broken"))
    return decisions.groupBy("action").agg(F.count("*").alias("ok")).join(bad, "action", "full").select("action", (F.coalesce("ok", F.lit(0)) + F.coalesce("broken", F.lit(0))).alias("n"), F.coalesce("broken", F.lit(0)).alias("broken"))


@query("scan_state_tables", "SELECT o_custkey AS listing_id, count(*) AS runs, max(o_orderdate) AS last_run, min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def scan_state_tables(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("listing_id")).agg(F.count("*").alias("runs"), F.max("o_orderdate").alias("last_run"), F.min("o_orderkey").alias("first_id"))


@query("extract_page_links", "SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages)")
def extract_page_links(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    rows = pages.select("page_id", "url", F.explode(F.array_distinct(S.page_links(pages))).alias("target"))
    return rows.select("page_id", S.absolute(F.col("url"), F.col("target")).alias("link")).distinct()


@query("scan_reviewed_inputs", "SELECT listing_id, problem FROM (SELECT listing_id, 'price' AS problem FROM listings WHERE NOT coalesce(price_monthly > 100, false) UNION ALL SELECT listing_id, 'bounds' FROM listings WHERE NOT coalesce(latitude BETWEEN 42 AND 44, false) UNION ALL SELECT listing_id, 'status' FROM listings WHERE listing_status <> 'active')")
def scan_reviewed_inputs(spark, sf_dir):
    checks = {"price": F.col("price_monthly") > 100, "bounds": F.col("latitude").between(42, 44), "status": F.col("listing_status") == "active"}
    return S.violations(frame(spark, sf_dir, "listings"), "listing_id", checks)


@query("sink_json_lines", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS balance FROM supplier")
def sink_json_lines(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("balance"))
    path = scratch_path(spark, "lines")
    S.write_json_lines(rows, path, "id")
    return spark.read.schema(rows.schema).json(path)


@query("sink_partitioned_upsert", "SELECT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'stored' END AS origin FROM (SELECT DISTINCT o_custkey FROM orders)")
def sink_partitioned_upsert(spark, sf_dir):
    keys = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    merged = S.upsert_by_key(keys.withColumn("origin", F.lit("stored")), keys.where("id % 2 = 0").withColumn("origin", F.lit("new")), "id")
    path = scratch_path(spark, "upsert")
    merged.withColumn("part", F.pmod("id", F.lit(4))).write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).select("id", "origin")


_HALF = "c_nationkey % 3 = 0 OR c_custkey % 2 = 0"


@query("snapshot_promote", f"""SELECT attempt, status, c_nationkey AS dataset, count(*) AS n
  FROM (VALUES (1, 'promoted', false), (2, 'already_imported', false), (3, 'promoted', true), (4, 'out_of_order', true), (5, 'reused', true), (6, 'rolled_back', false), (7, 'already_imported', false)) v(attempt, status, whole) JOIN customer ON whole OR {_HALF} GROUP BY ALL""")
def snapshot_promote(spark, sf_dir):
    """Runs into one versioned table, and what its readers see after each: a replay, a late run and equal rows change nothing."""
    whole = load(spark, sf_dir, "customer")
    half = whole.where(_HALF)
    table = VersionedTable(spark, scratch_path(spark, "customers"))
    seen = []
    for attempt, (rows, run, month) in enumerate(((half, "r1", 1), (whole, "r1", 1), (whole, "r3", 3), (half, "r2", 2), (whole, "r4", 4), (None, None, None), (whole, "r3", 3)), 1):
        try:
            status = table.publish(rows, run, datetime(2024, month, 1))[0] if rows else table.rollback().status
        except OutOfOrderRun:
            status = "out_of_order"
        now = table.read().groupBy(F.col("c_nationkey").alias("dataset")).agg(F.count("*").alias("n"))
        seen.append(now.select(F.lit(attempt).alias("attempt"), F.lit(status).alias("status"), "dataset", "n"))
    return reduce(DataFrame.unionByName, seen)


@query("prepare_canonical", """SELECT listing_id, CASE WHEN price_monthly IS NULL THEN 'missing_price|' ELSE '' END || CASE WHEN housing_type IS NULL THEN 'missing_type' ELSE '' END AS issues, lower(housing_type) AS kind, split_part(address, ' ', 1) AS house_number FROM listings""")
def prepare_canonical(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings")
    street = A.address_parts(F.col("address"))["street"]
    issues = F.concat(F.when(F.col("price_monthly").isNull(), "missing_price|").otherwise(""), F.when(F.col("housing_type").isNull(), "missing_type").otherwise(""))
    return rows.select("listing_id", issues.alias("issues"), X.comparison_text(F.col("housing_type")).alias("kind"), F.substring_index(street, " ", 1).alias("house_number"))


_VIEW = """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) AS k FROM observations) WHERE k = 1), f AS (SELECT listing_id, min(run_day) AS first_seen, max(run_day) AS last_seen FROM observations GROUP BY 1)"""


def _active(spark, sf_dir):
    rows = frame(spark, sf_dir, "observations")
    return rows.groupBy("listing_id").agg(F.max_by(F.struct("id", "listing_status", "price_monthly", "props"), F.struct("observed_at", "id")).alias("o"), F.min("run_day").alias("first_seen"), F.max("run_day").alias("last_seen")).select("listing_id", "o.*", "first_seen", "last_seen").where("listing_status <> 'removed'")


@query("view_active", f"{_VIEW} SELECT o.listing_id, o.id, o.price_monthly, CAST(json_extract_string(props, '$.k') AS INT) AS k, first_seen, last_seen FROM o JOIN f USING (listing_id) WHERE listing_status <> 'removed'")
def view_active(spark, sf_dir):
    return _active(spark, sf_dir).select("listing_id", "id", "price_monthly", F.get_json_object("props", "$.k").cast("int").alias("k"), "first_seen", "last_seen")


_RANKED = f"{_VIEW}, s AS (SELECT property_id, max(ranking_overall_score) AS score FROM listings WHERE ranking_status = 'ranked' GROUP BY 1) SELECT o.listing_id, s.score, CASE WHEN s.score >= 95 THEN 'confirmed' WHEN s.score IS NULL THEN 'needs-review' ELSE 'parsed' END AS quality FROM o LEFT JOIN s ON s.property_id = o.listing_id WHERE listing_status <> 'removed'"


def _ranked(spark, sf_dir):
    score = frame(spark, sf_dir, "listings").where("ranking_status = 'ranked'").groupBy(F.col("property_id").alias("listing_id")).agg(F.max("ranking_overall_score").alias("score"))
    return _active(spark, sf_dir).join(score, "listing_id", "left").withColumn("quality", F.when(F.col("score") >= 95, "confirmed").when(F.col("score").isNull(), "needs-review").otherwise("parsed"))


@query("view_ranked", _RANKED)
def view_ranked(spark, sf_dir):
    return _ranked(spark, sf_dir).select("listing_id", "score", "quality")


@query("view_product", f"SELECT r.listing_id, r.score, coalesce(v.visible, false) AS location_map_visible, coalesce(v.status, 'unavailable') AS location_status FROM ({_RANKED}) r LEFT JOIN (SELECT property_id, bool_and(location_map_visible) AS visible, max('verified') AS status FROM listings WHERE property_id % 2 = 0 GROUP BY 1) v ON v.property_id = r.listing_id")
def view_product(spark, sf_dir):
    visible = frame(spark, sf_dir, "listings").where("property_id % 2 = 0").groupBy(F.col("property_id").alias("listing_id")).agg(F.bool_and("location_map_visible").alias("v"))
    rows = _ranked(spark, sf_dir).join(visible, "listing_id", "left")
    return rows.select("listing_id", "score", F.coalesce("v", F.lit(False)).alias("location_map_visible"), F.when(F.col("v").isNotNull(), "verified").otherwise("unavailable").alias("location_status"))


@query("project_json_whitelist", "SELECT event_id, concat(chr(123), '\"k\":', json_extract_string(props, '$.k'), chr(125)) AS public FROM events")
def project_json_whitelist(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.to_json(F.from_json("props", "k int")).alias("public"))


@query("split_evidence_maps", "SELECT listing_id, 'price_source|type_rule' AS provenance, 'geocode_confidence' AS confidence FROM listings")
def split_evidence_maps(spark, sf_dir):
    raw = F.create_map(F.lit("price_source"), F.lit("rule"), F.lit("type_rule"), F.col("housing_type"), F.lit("geocode_confidence"), F.col("geocode_confidence").cast("string"), F.lit("title"), F.col("title"))
    keys = lambda test: F.array_join(F.array_sort(F.map_keys(F.map_filter(raw, lambda k, v: test(k)))), "|")
    return frame(spark, sf_dir, "listings").select("listing_id", keys(lambda k: k.endswith("_source") | k.endswith("_rule") | k.startswith("manual")).alias("provenance"), keys(lambda k: k.contains("confidence") | k.startswith("ai_evidence_")).alias("confidence"))


@query("project_route_detail", "SELECT l_orderkey AS route, count(*) AS legs, string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_partkey, l_suppkey) AS modes FROM lineitem GROUP BY 1")
def project_route_detail(spark, sf_dir):
    leg = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("geometry"))
    routes = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    public = routes.withColumn("legs", F.transform("legs", lambda x: x.dropFields("geometry")))
    return public.select("route", F.size("legs").cast("long").alias("legs"), F.array_join(F.transform("legs", lambda x: x.mode), ">").alias("modes"))


@query("project_geojson", """SELECT place_id, concat(chr(123), '"type":"Point","coordinates":[', CAST(CAST(x AS BIGINT) AS VARCHAR), ',', CAST(CAST(y AS BIGINT) AS VARCHAR), ']', chr(125)) AS geojson FROM places""")
def project_geojson(spark, sf_dir):
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("x").cast("long"), F.col("y").cast("long")).alias("coordinates"))
    return frame(spark, sf_dir, "places").select("place_id", F.to_json(point).alias("geojson"))
