"""Operators on tiny rows: the reference's metamorphic properties and corner cases."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import addresses, geo, temporal, text
from tidewell.operators import access, filters, history, lifecycle, quality, ranking, reuse, sorts, spatial
from tidewell.streaming import lifecycle as stream


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def listing(i, price, structure="entire", kind="house", bedrooms=2, lease="fixed", status="active"):
    return (i, i, status, price, structure, kind, bedrooms, lease)


MARKET = "listing_id long, property_id long, listing_status string, price_monthly double, rental_structure string, housing_type string, bedrooms int, lease_type string"


def scored(spark, rows):
    market = ranking.market_rows(spark.createDataFrame(rows, MARKET))
    based = ranking.cohort_percentile(ranking.select_baselines(market, ranking.market_cohorts(market)), market)
    b = F.col("baseline")
    return {r.listing_id: r for r in based.select("listing_id", "price_percentile", b.level.alias("level"), b.median.alias("median"), ranking.value_score(F.col("price_monthly"), b.median, b.p25, b.p75).alias("score")).collect()}


def test_lower_price_never_scores_lower(spark):
    got = scored(spark, [listing(i, 500.0 + 50 * i) for i in range(12)])
    scores = [got[i].score for i in range(12)]
    assert scores == sorted(scores, reverse=True) and all(5 <= s <= 95 for s in scores)
    assert [got[i].price_percentile for i in (0, 11)] == [0, 100]


def test_baseline_widens_until_the_cohort_is_usable(spark):
    rows = [listing(i, 600.0 + i) for i in range(7)] + [listing(20 + i, 700.0 + i, lease=None) for i in range(3)] + [listing(40, 900.0, bedrooms=5), listing(50, 100.0), listing(51, 800.0, status="removed")]
    got = scored(spark, rows)
    assert got[0].level == "structure_type_bedrooms" and got[20].level == "structure_type_bedrooms" and got[40].level == "structure_type"
    assert 50 not in got and 51 not in got
    flat = scored(spark, [listing(i, 500.0) for i in range(9)])
    assert flat[0].level == "relevant_market" and flat[0].score == 50 and flat[0].price_percentile == 50


def test_transit_score_falls_with_duration(spark):
    columns = [F.lit(None).cast("int") if x is None else F.lit(x) for x in (0, 1, 600, 600, 3, 0, 0, 3)]
    walking, transfers, low, high, available, better, none, requested = columns
    score = lambda d: one(spark, s=ranking.transit_period_score(F.lit(d), walking, transfers, low, high, available, better, none, requested)).s
    values = [score(d) for d in (300, 900, 2400, 6000)]
    assert values == sorted(values, reverse=True) and all(0 <= v <= 100 for v in values)


def test_unknown_never_satisfies_a_filter(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 900.0, True), (3, 1200.0, False)], "listing_id long, price_monthly double, furnished boolean")
    keep = lambda q: [r.listing_id for r in rows.where(q.predicate()).orderBy("listing_id").collect()]
    assert keep(filters.ListingQuery(min_price=0)) == [2, 3] and keep(filters.ListingQuery(furnished=False)) == [3] and keep(filters.ListingQuery()) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.ids_in("listing_id", range(101))


def test_page_puts_nulls_last_both_ways(spark):
    rows = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0), (4, 5.0)], "listing_id long, price_monthly double")
    ids = lambda sort: [r.listing_id for r in sorts.page(rows, sort, 10).collect()]
    assert ids("price_low") == [3, 2, 4, 1] and ids("price_high") == [2, 4, 3, 1]


def test_price_period_belongs_to_the_amount(spark):
    got = one(spark, a=text.price_period(F.lit("$900 per month")), b=text.price_period(F.lit("$900. Cleaning monthly")), c=text.price_monthly(F.lit(100.0), F.lit("week")), d=text.price_amount(F.lit("from $1,250.50/mo")))
    assert (got.a, got.b, got.c, got.d) == ("month", None, 433.33, 1250.5)


def test_address_units(spark):
    def parts(value):
        got = one(spark, p=addresses.address_parts(F.lit(value))).p
        return got.street, got.unit, got.ambiguous, got.complete

    assert parts("Apt 3, 12 King Street, London, ON, Canada") == ("12 king st", "apt:3", False, True)
    assert parts("4-12 King Street") == ("12 king st", "unit:4", False, True)
    assert parts("12 King Street #b") == ("12 king st", "unit:b", False, True)
    assert parts("12 King Court") == parts("12 King Ct") == ("12 king ct", None, False, True)
    assert parts("12 King Street unit 3 rm 4") == ("12 king st unit 3 rm 4", None, True, True)
    assert parts("Basement, King Terrace") == ("basement king terr", None, True, False)
    assert parts("12 King Crescent North") == ("12 king crescent north", None, False, True)
    assert parts("") == (None, None, False, False)


def test_civic_addresses(spark):
    def civic(value):
        got = one(spark, p=addresses.civic_parts(F.lit(value))).p
        return got.civic, got.unit

    assert civic("12 King Court") == civic("12 king CT.") == ("12 KING CT", None)
    assert civic("12 Old Queen Terrace West, Unit 4-B") == ("12 OLD QUEEN TER W", "4-B")
    assert civic("North") == ("N", None) and civic("") == (None, None)


def test_months_wrap(spark):
    got = one(spark, m=text.month_interval(F.lit("Nov to Feb")), s=text.summer_overlap(text.month_interval(F.lit("april until june"))), n=text.month_interval(F.lit("any time")))
    assert (got.m, got.s, got.n) == ([11, 12, 1, 2], "summer", None)


def test_geometry(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3), (0, 0))))
    got = one(spark, a=geo.ring_area(ring), l=geo.line_length(ring), i=geo.point_in_ring(F.lit(1.0), F.lit(1.0), ring), o=geo.point_in_ring(F.lit(5.0), F.lit(1.0), ring), d=geo.point_segment(*(F.lit(float(v)) for v in (2, 5, 0, 0, 4, 0))), h=geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert (got.a, got.l, got.i, got.o, got.d) == (12, 14, True, False, 5) and got.h == pytest.approx(math.radians(1) * geo.EARTH_RADIUS)
    utm = one(spark, e=geo.to_utm17(F.lit(43.0), F.lit(-81.0))[0], n=geo.to_utm17(F.lit(43.0), F.lit(-81.0))[1])
    assert utm.e == pytest.approx(500000) and utm.n == pytest.approx(4760814.8, abs=1)


def test_nearest_and_overlap(spark):
    points = spark.createDataFrame([(i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(40)], "place_id long, x double, y double")
    stops = spark.createDataFrame([(i, float(i * 29 % 101), float(i * 71 % 97)) for i in range(9)], "stop_id long, x double, y double")
    got = {r.place_id: r.nearest for r in spatial.join_nearest(points, stops, "place_id", "stop_id", 5.0, 160.0).collect()}
    all_stops = stops.collect()
    for p in points.collect():
        assert got[p.place_id] == min(all_stops, key=lambda s: (math.hypot(p.x - s.x, p.y - s.y), s.stop_id)).stop_id
    route = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0, 1)], "route_id long, x1 double, y1 double, x2 double, y2 double, step int")
    lanes = spark.createDataFrame([(1, "a", 0.0, 3.0, 50.0, 3.0), (2, "b", 0.0, 4.0, 50.0, 4.0), (3, "b", 70.0, -20.0, 70.0, 20.0), (4, "a", 90.0, 1.0, 90.0, 1.0)], "facility_id long, category string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.tolerance, r.category): r.overlap for r in spatial.overlap_share(route, lanes, "route_id", (2.0, 5.0), 10.0).collect()}
    near, tip = 50 + math.sqrt(5**2 - 3**2), 2 * math.sqrt(5**2 - 1)
    want = {(5.0, None): near + 10 + tip, (5.0, "a"): near + tip, (5.0, "b"): 50 + 3 + 10, (2.0, None): 4 + 2 * math.sqrt(3), (2.0, "a"): 2 * math.sqrt(3), (2.0, "b"): 4.0}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_duplicate_ads_name_their_group(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "x", 5), (2, "x", 5), (3, "x", 6), (4, None, 5), (5, None, 5), (9, "x", 5)], "id long, k string, price int")
    assert sorted(tuple(r) for r in lifecycle.duplicate_ads(rows, "id", ["k", "price"]).collect()) == [(1, 1, 3), (2, 1, 3), (9, 1, 3)]


def test_numbered_equals_the_sorted_order(spark):
    values = [None if i % 17 == 0 else float(i * 7919 % 50) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r.id: r.at for r in history.numbered(rows, "v", "id", "at", 10).collect()}
    want = sorted(range(300), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert [got[i] for i in want] == list(range(300))
    assert history.spread_sample(rows, "v", "id", 7).count() == 7 and history.spread_sample(rows.limit(0), "v", "id", 7).count() == 0


def test_absence_runs(spark):
    runs = spark.createDataFrame([(d,) for d in range(5)], "run int")
    seen = spark.createDataFrame([(1, 4), (2, 3), (3, 1), (3, 0)], "listing_id long, run int")
    got = {r.listing_id: (r.missed, r.status) for r in history.absence_runs(seen, runs, "listing_id", "run").collect()}
    assert got == {1: (0, "active"), 2: (1, "possibly_removed"), 3: (3, "removed")}


def test_page_stop(spark):
    pages = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["c", "b"]), (4, ["z"])], "page int, urls array<string>")
    assert [(r.page, r.new_urls, r.seen) for r in history.page_stop(pages, "page", "urls").orderBy("page").collect()] == [(1, 2, 2), (2, 1, 3)]


def test_scd2_is_idempotent(spark):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, v string").withColumn("valid_from", at)
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (4, "e")], "id long, v string")
    merged = lifecycle.scd2_merge(old, new, "id", ["v"], at)
    assert sorted((r.id, r.v, r.action) for r in merged.collect() if r.action != "kept") == [(3, "c", "closed"), (3, "d", "inserted"), (4, "e", "inserted")]
    current = merged.where("is_current").select("id", "v", "valid_from")
    assert {r.action for r in lifecycle.scd2_merge(current, new, "id", ["v"], at).collect()} == {"kept"}


def test_append_once_replay_is_a_no_op(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "a int, b int")
    assert lifecycle.append_once(rows, rows.limit(0), ["a", "b"]).count() == 2 and lifecycle.append_once(rows, rows, ["a", "b"]).count() == 0


def test_evidence_must_be_verbatim_and_support(spark):
    rows = spark.createDataFrame([("x", "Is FURNISHED", True), ("x", "absent", True), ("x", "furnished", False), ("x", "", True), (None, "furnished", True)], "v string, e string, s boolean")
    value, blocked = quality.evidence_gate(F.col("v"), F.col("e"), F.array(F.lit("it is furnished")), F.col("s"))
    assert [tuple(r) for r in rows.select(value, blocked).collect()] == [("x", False), (None, True), (None, True), (None, True), (None, False)]


def test_fingerprint_ignores_order(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id long, v string")
    assert quality.table_fingerprint(rows, "id", ["v"]).first() == quality.table_fingerprint(rows.orderBy(F.desc("id")), "id", ["v"]).first()
    assert quality.table_fingerprint(rows, "id", ["v"]).first() != quality.table_fingerprint(rows.withColumn("v", F.upper("v")), "id", ["v"]).first()


def test_every_tier_of_the_ladder(spark):
    """A request for each tier; metres are by the degree of latitude, 111,195 of them."""
    step = 1 / 111_195
    at = datetime(2026, 1, 1)
    ask = "request_id long, property_id long, latitude double, longitude double, nearest_stop_id string, walking_to_stop_seconds int, hotspot_id string, travel_mode string"
    requests = spark.createDataFrame(
        [(1, 1, 10.0, 0.0, None, None, "h", "walking"), (2, 2, 20.0, 0.0, None, None, "h", "walking"), (3, 3, 30.0, 0.0, "s", 100, "h", "transit"), (4, 4, 40.0, 0.0, None, None, "h", "cycling"), (5, 5, 50.0, 0.0, None, None, "h", "walking"),
         (6, 6, 60.0, 0.0, None, None, "h", "walking"), (7, 7, 70.0, 0.0, "t", 5, "h", "transit"), (8, 8, None, None, None, None, "h", "walking"), (9, 9, 10.0, 0.0, None, None, "other", "walking"), (10, 1, None, None, None, None, "h", "walking")], ask)
    have = "profile_id long, property_id long, latitude double, longitude double, nearest_stop_id string, duration int, shortest int, longest int, distance int, walking int, confidence double, to_destination int, origin_walk int, calculated_at timestamp, is_stale boolean, expires_at timestamp, hotspot_id string, travel_mode string"
    old, new, soon = datetime(2025, 1, 1), datetime(2025, 6, 1), datetime(2026, 6, 1)
    row = lambda i, prop, lat, mode, when=new, stale=False, until=soon, stop=None, conf=0.8, **v: (i, prop, lat, 0.0, stop, v.get("d", 500), 400, 600, 1000, v.get("w"), conf, v.get("to"), v.get("ow"), when, stale, until, "h", mode)
    profiles = spark.createDataFrame(
        [row(11, 1, 10.0 + 15 * step, "walking", old), row(12, 1, 10.0 + 19 * step, "walking"), row(13, 1, 10.0 + 30 * step, "walking", soon), row(14, 99, 10.0, "walking", soon),  # 13 moved too far, 14 is another's
         row(21, 77, 20.0 + 2 * step, "walking"), row(22, 77, 20.0 + 4 * step, "walking", soon), row(23, 2, 20.0 + 25 * step, "walking", soon),
         row(31, 70, 31.0, "transit", stop="s", to=300, ow=40, conf=0.0), row(32, 70, 31.0, "transit", soon, stop="s"), row(33, 71, 31.0, "transit", soon, True, stop="s", to=1),
         row(41, 80, 40.0 + 100 * step, "cycling"), row(42, 81, 40.0 - 60 * step, "cycling", old, conf=None), row(43, 82, 40.0 + 50 * step, "cycling", soon, until=at), row(44, 83, 40.0 + 126 * step, "cycling", soon),
         row(51, 5, 50.0, "walking", old, until=at), row(52, None, 50.0 + step, "walking", new, True), row(53, 5, 50.0 + 21 * step, "walking", soon, True)], have)
    goals = spark.createDataFrame([("h", 60.0 + 1000 * step, 0.0), ("other", None, None)], "hotspot_id string, latitude double, longitude double")
    got = {r.request_id: r for r in reuse.resolve_access(requests, profiles, goals, at, ["hotspot_id", "travel_mode"]).collect()}
    of = lambda i, *names: tuple(got[i][n] for n in ("result_type", "profile_id", "source_profile_id", *names))
    assert of(1) == ("cached_exact_property", 12, None) and of(10) == ("cached_exact_property", 13, None)  # without coordinates any of its own
    assert of(2) == ("cached_exact_origin", 21, None)
    assert of(3, "duration", "shortest", "longest", "walking", "confidence") == ("same_stop_reuse", None, 31, 400, 460, 660, 100, 0.63)
    more = math.ceil(math.ceil(got[4].connector_metres * 1.35) / (15 * 1000 / 3600))
    assert of(4, "duration", "distance", "confidence") == ("nearby_origin_estimate", None, 42, 500 + more, 1000 + math.ceil(got[4].connector_metres * 1.35), round(0.7 * 0.85 * (1 - 0.25 * got[4].connector_metres / 125), 3)) and abs(got[4].connector_metres - 60) < 0.1
    assert of(5, "is_estimate") == ("stale", 52, None, False)
    assert of(6, "duration", "distance", "confidence") == ("straight_line_estimate", None, None, 750, 1000, 0.65)
    assert [of(i)[0] for i in (7, 8, 9)] == ["pending_provider", "unavailable", "unavailable"]
    assert len(got) == 10


def test_ladder_shuffles_requests_once_a_lookup(spark):
    """requests were shuffled five times, sorted each time, and answers kept twice."""
    from tidewell.plans import access as plans

    requests, profiles, goals = plans._travel(spark, "/root/testdata/sf0.001")
    for test, most, more in (("true", 3, {}), ("travel_mode <> 'transit'", 2, {"transit": False})):
        rows = reuse.resolve_access(requests.where(test), profiles.where(test), goals, plans._AT, plans._SAME, **more)
        plan = rows._jdf.queryExecution().executedPlan()
        nodes, wide = [plan], []
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Exchange" and "request_id" in node.output().mkString(","):
                wide.append(node)
            nodes += [node.initialPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.children().apply(i) for i in range(node.children().size())]
        assert 1 <= len(wide) <= most, plan.toString()
        assert rows.count() == requests.where(test).count()


def test_ladder_ignores_profiles_of_unknown_state(spark):
    """A profile that may or may not be current is neither; repeated profiles are one; of own and near stale ones the freshest answers."""
    at, old, new = datetime(2026, 1, 1), datetime(2025, 1, 1), datetime(2025, 6, 1)
    ask = "request_id long, property_id long, latitude double, longitude double, nearest_stop_id string, walking_to_stop_seconds int, hotspot_id string, travel_mode string"
    requests = spark.createDataFrame([(1, 1, 10.0, 0.0, None, None, "h", "walking"), (2, 2, 20.0, 0.0, None, None, "h", None), (3, None, 10.0, None, "s", 9, "h", "transit")], ask)
    have = "profile_id long, property_id long, latitude double, longitude double, nearest_stop_id string, duration int, shortest int, longest int, distance int, walking int, confidence double, to_destination int, origin_walk int, calculated_at timestamp, is_stale boolean, expires_at timestamp, hotspot_id string, travel_mode string"
    row = lambda i, prop, lat, mode, when, stale: (i, prop, lat, 0.0, None, 500, 400, 600, 1000, None, 0.8, None, None, when, stale, None, "h", mode)
    rows = [row(10, 1, 10.0, "walking", new, None), row(11, 1, 10.0, "walking", old, True), row(11, 1, 10.0, "walking", old, True), row(20, 2, 20.0, None, old, True), row(21, 9, 20.0, None, new, True)]
    goals = spark.createDataFrame([("h", None, None)], "hotspot_id string, latitude double, longitude double")
    got = {r.request_id: (r.result_type, r.profile_id) for r in reuse.resolve_access(requests, spark.createDataFrame(rows, have), goals, at, ["hotspot_id", "travel_mode"]).collect()}
    assert got == {1: ("stale", 11), 2: ("stale", 21), 3: ("unavailable", None)}


def test_near_points_at_poles_and_date_line(spark):
    rows = lambda *xs: spark.createDataFrame(list(xs), "latitude double, longitude double")
    left = rows((89.9999, 0.0), (0.0, 179.9999), (None, 1.0), (0.0, 179.9999))
    right = rows((89.9999, 180.0), (0.0, -179.9999), (0.0, 179.0), (1.0, None))
    assert {(r.latitude, r.near_longitude) for r in reuse.near_points(left, right, 25.0).collect()} == {(89.9999, 180.0), (0.0, -179.9999)}


def test_service_days(spark):
    calendar = spark.createDataFrame([("a", date(2026, 1, 5), date(2026, 1, 11), 1, 0, 0, 0, 0, 1, 0)], "service_id string, start_date date, end_date date, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int")
    extra = spark.createDataFrame([("a", date(2026, 1, 6), 1), ("a", date(2026, 1, 10), 2)], "service_id string, day date, exception_type int")
    assert [r.day for r in temporal.service_days(calendar, extra).orderBy("day").collect()] == [date(2026, 1, 5), date(2026, 1, 6)]


def test_stream_of_runs(spark, tmp_path):
    source = tmp_path / "runs"
    schema = "listing_id long, hash string, observed_at timestamp"
    for number, ids in enumerate(((1, 2), (2,), (2, 3))):
        spark.createDataFrame([(i, "h", datetime(2024, 1, number + 1)) for i in ids], schema).coalesce(1).write.parquet(f"{source}/{number}")
        runs = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        stream.lifecycle_stream(runs, f"{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination(120)
    state = {r.listing_id: (r.status, r.missed) for r in stream.read_state(spark, f"{tmp_path}/state", 2).collect()}
    assert state == {1: ("removed", 2), 2: ("active", 0), 3: ("active", 0)}
    late = stream.merge_run(stream.read_state(spark, f"{tmp_path}/state", 2), spark.createDataFrame([(2, "old", datetime(2023, 1, 1))], schema))
    assert {r.listing_id: r.last_hash for r in late.collect()}[2] == "h"


def test_property_conflicts(spark):
    rows = spark.createDataFrame(
        [(43.0000001, -81.0, "1 a st", None), (43.0, -81.0, "2 b st", "4"), (43.00001, -81.0, "1 a st", "2"), (None, -81.0, "3 c st", None), (43.5, None, None, "1")],
        "latitude double, longitude double, address string, unit string",
    )
    got = {tuple(r) for r in quality.property_conflicts(rows).collect()}
    assert got == {("several_addresses", "43000000,-81000000", 2), ("unit_presence_differs", "1 a st", 1)}
    assert quality.property_conflicts(rows.limit(0)).count() == 0


def test_geocode_resolution_names_the_first_failure(spark):
    names = "id int, address string, geocode_query string, latitude double, longitude double, geocode_confidence double, geocode_status string, geocode_result_type string, geocode_match_type string"
    good = ("1 A St", "1 a st", 43.0, -81.2, 0.99, "ok", "building", "full_match")
    bad = {1: None, 2: ("1 A St", "other"), 3: (None,), 4: ("9 Z St", "9 z st"), 5: ("2 B St", "2 b st"), 6: good[:2] + (43.1,), 7: good[:7] + ("inner_part",), 8: good[:6] + ("street",), 9: ("3 C St", "3 c st", 43.0, -81.2, 0.99, "failed")}
    rows = spark.createDataFrame([(i, *(b or ()), *good[len(b or ()) :]) for i, b in bad.items()], names)
    said = (43.0, -81.2, 0.99)
    cache = spark.createDataFrame([("1 a st", None, *said, "ok"), ("2 b st", "x", *said, "ok"), ("2 b st", "x", *said, "ok"), ("3 c st", "First", *said, "failed")], "query string, provider string, latitude double, longitude double, geocode_confidence double, geocode_status string")
    got = {r.id: r.reason for r in quality.geocode_resolution(rows, cache, "first", (42.9, 43.05), (-81.4, -81.1), 0.8).collect()}
    assert got == {
        1: "cached_geocode_verified", 2: "geocode_address_query_mismatch", 3: "geocode_address_query_mismatch", 4: "geocode_cache_evidence_missing", 5: "geocode_multiple_cached_candidates",
        6: "geocode_cache_result_mismatch", 7: "geocode_full_match_required", 8: "geocode_property_precision_required", 9: "geocode_status_not_ok",
    }


def test_contract_gate_in_order(spark):
    rows = spark.createDataFrame([(29, 1, 9.0, 1, 9), (30, 1, 9.0, 1, 9), (30, 0, 5.1, 1, 9), (30, 0, 5.0, 79, 100), (30, 0, 5.0, 80, 100)], "a int, b int, c double, d int, e int")
    got = [r.gate for r in rows.select(access.contract_gate(*map(F.col, "abcde")).alias("gate")).collect()]
    assert got == ["too_few_pairs", "one_sided", "error_too_large", "too_little_coverage", "accepted"]


def test_label_counts_of_a_field_that_one_side_lacks(spark):
    old = spark.createDataFrame([("a", 1), (" ", 2)], "kind string, n int")
    got = {tuple(r) for r in quality.label_counts(old, old.drop("n"), ["kind", "n", "other"]).collect()}
    assert got == {("kind", "a", 1, 1), ("kind", "<unknown>", 1, 1), ("n", "1", 1, 0), ("n", "2", 1, 0)}
