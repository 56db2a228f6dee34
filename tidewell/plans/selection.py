"""Reference matching, selection, promotion, triage and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..functions import addresses as A
from ..functions import text as X
from ..operators import decisions as D
from ..operators import evidence as E
from ..operators import history as H
from ..operators import quality as Q
from ..operators import validation as V
from ..operators.sorts import top_per_key
from . import quality, text  # noqa: F401  their frames are used here
from .frames import FRAMES, frame, load
from .registry import query

FRAMES["properties"] = "SELECT c_custkey AS property_id, c_custkey % 400 AS civic, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 7 AS STRING) END AS unit, CAST(c_acctbal * 10 AS DOUBLE) AS x FROM customer"
FRAMES["officials"] = "SELECT s_suppkey AS official_id, s_suppkey * 3 % 400 AS civic, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey % 7 AS STRING) END AS unit, CAST(s_acctbal * 10 AS DOUBLE) AS x, CASE s_suppkey % 6 WHEN 0 THEN 'retired' ELSE 'active' END AS status FROM supplier"


def _matched(spark, sf_dir):
    p, o = frame(spark, sf_dir, "properties"), frame(spark, sf_dir, "officials")
    hits = p.join(o.select("official_id", "civic", F.col("unit").alias("o_unit"), F.col("x").alias("o_x"), "status"), "civic", "left")
    exact = F.col("unit").isNull() | F.col("unit").eqNullSafe(F.col("o_unit"))
    counted = hits.withColumn("fits", F.col("official_id").isNotNull() & exact).groupBy("property_id").agg(F.count("official_id").alias("n"), F.count_if("fits").alias("n_fit"), F.min(F.when(F.col("fits"), F.col("official_id"))).alias("official_id"))
    method = F.when(F.col("n") == 0, "no_address").when(F.col("n_fit") == 0, "unit_mismatch").when(F.col("n_fit") > 1, "ambiguous").otherwise("exact")
    return counted.withColumn("method", method)


_MATCH = """SELECT property_id, CASE WHEN n = 0 THEN 'no_address' WHEN n_fit = 0 THEN 'unit_mismatch' WHEN n_fit > 1 THEN 'ambiguous' ELSE 'exact' END AS method, CASE WHEN n_fit = 1 THEN one END AS official_id FROM
  (SELECT property_id, count(official_id) AS n, count(*) FILTER (official_id IS NOT NULL AND (p.unit IS NULL OR p.unit = o.unit)) AS n_fit, min(official_id) FILTER (p.unit IS NULL OR p.unit = o.unit) AS one FROM properties p LEFT JOIN officials o ON o.civic = p.civic GROUP BY 1)"""


@query("join_address_match", _MATCH)
def join_address_match(spark, sf_dir):
    return _matched(spark, sf_dir).select("property_id", "method", F.when(F.col("n_fit") == 1, F.col("official_id")).alias("official_id"))


_REFS = f"SELECT p.property_id, m.method, l.n AS listings, coalesce(r.n, 0) AS profiles, o.status FROM properties p JOIN ({_MATCH}) m USING (property_id) LEFT JOIN (SELECT property_id, count(*) AS n FROM listings GROUP BY 1) l ON l.property_id = p.property_id LEFT JOIN (SELECT property_id, count(*) AS n FROM profiles GROUP BY 1) r ON r.property_id = p.property_id LEFT JOIN officials o ON o.official_id = m.official_id"


def _refs(spark, sf_dir):
    """Each property with its match and counts of what depends on it; every side is aggregated to a row per property first."""
    count = lambda name, out: frame(spark, sf_dir, name).groupBy("property_id").agg(F.count("*").alias(out))
    rows = frame(spark, sf_dir, "properties").join(join_address_match(spark, sf_dir), "property_id").join(count("listings", "listings"), "property_id", "left").join(count("profiles", "profiles"), "property_id", "left")
    official = frame(spark, sf_dir, "officials").select("official_id", "status", F.col("x").alias("o_x"))
    return rows.join(official, "official_id", "left").withColumn("profiles", F.coalesce("profiles", F.lit(0)))


@query("join_current_refs", _REFS)
def join_current_refs(spark, sf_dir):
    return _refs(spark, sf_dir).select("property_id", "method", "listings", "profiles", "status")


@query("join_evidence_stale", "SELECT a.property_id, CASE WHEN b.property_id IS NULL THEN 'gone' WHEN a.segment IS DISTINCT FROM b.segment OR a.nation IS DISTINCT FROM b.nation THEN 'stale' ELSE 'eligible' END AS state, concat_ws('|', CASE WHEN a.nation IS DISTINCT FROM b.nation THEN 'nation' END, CASE WHEN a.segment IS DISTINCT FROM b.segment THEN 'segment' END) AS differing FROM (SELECT c_custkey AS property_id, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer) a LEFT JOIN (SELECT c_custkey AS property_id, CASE WHEN c_custkey % 9 = 0 THEN 'X' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer WHERE c_custkey % 11 <> 0) b ON a.property_id = b.property_id")
def join_evidence_stale(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("property_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    pack = F.create_map(F.lit("nation"), F.col("nation"), F.lit("segment"), F.col("segment"))
    i = F.col("property_id")
    now = c.where(i % 11 != 0).withColumns({"segment": F.when(i % 9 == 0, "X").otherwise(F.col("segment")), "nation": F.when(i % 6 != 0, F.col("nation"))}).select("property_id", pack.alias("now"))
    rows = c.select("property_id", pack.alias("frozen")).join(now, "property_id", "left")
    other = F.coalesce("now", F.map_from_arrays(F.map_keys("frozen"), F.transform(F.map_keys("frozen"), lambda k: F.lit(None).cast("string"))))
    differing = F.map_keys(F.map_filter(F.map_zip_with("frozen", other, lambda k, a, b: ~a.eqNullSafe(b)), lambda k, d: d))
    state = F.when(F.col("now").isNull(), "gone").when(F.size(differing) > 0, "stale").otherwise("eligible")
    return rows.select("property_id", state.alias("state"), F.array_join(differing, "|").alias("differing"))


_PROJ = f"SELECT property_id, CASE WHEN method = 'exact' AND status = 'active' THEN 'verified' WHEN listings IS NOT NULL THEN 'hidden' ELSE 'unavailable' END AS projected, CASE WHEN property_id % 3 = 0 THEN 'verified' ELSE 'hidden' END AS current FROM ({_REFS})"


def _projected(spark, sf_dir):
    projected = F.when((F.col("method") == "exact") & (F.col("status") == "active"), "verified").when(F.col("listings").isNotNull(), "hidden").otherwise("unavailable")
    return _refs(spark, sf_dir).select("property_id", projected.alias("projected"), F.when(F.col("property_id") % 3 == 0, "verified").otherwise("hidden").alias("current"))


@query("cls_visibility_project", f"SELECT current, projected, count(*) AS n FROM ({_PROJ}) GROUP BY 1, 2")
def cls_visibility_project(spark, sf_dir):
    return _projected(spark, sf_dir).groupBy("current", "projected").agg(F.count("*").alias("n"))


#: A table of location visibility with each fault.
FRAMES["visibility_rows"] = """
    SELECT CASE WHEN c_custkey % 71 = 5 THEN c_custkey - 1 ELSE c_custkey END AS property_id, CASE WHEN c_nationkey = 7 THEN 'v2' WHEN c_custkey % 97 = 0 THEN ' ' ELSE 'v1' END AS policy_version, CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE 'run' END AS source_run_id,
      CASE WHEN c_custkey % 83 = 0 THEN 'ABC' ELSE concat('0123456789abcdef0123456789abcdef', '0123456789abcdef0123456789abcdef') END AS source_fingerprint, CASE c_custkey % 5 WHEN 0 THEN 'limited' WHEN 1 THEN 'unavailable' WHEN 2 THEN CASE WHEN c_custkey % 79 = 0 THEN 'hidden' ELSE 'available' END ELSE 'available' END AS status,
      c_custkey % 5 <> 1 OR c_custkey % 73 = 0 AS map_visible, c_custkey % 5 >= 2 AND c_custkey % 61 <> 0 AS route_available, CASE c_custkey % 13 WHEN 0 THEN '[]' WHEN 1 THEN '["a", "b"]' WHEN 2 THEN '["a", " "]' WHEN 3 THEN 'a' WHEN 4 THEN NULL ELSE '["moved"]' END AS reason_codes
    FROM customer WHERE c_custkey % 11 <> 3"""


@query("cls_visibility_validate", """WITH v AS (SELECT *, count(*) OVER (PARTITION BY property_id) AS n FROM visibility_rows)
  SELECT property_id, 'id_not_positive' AS problem FROM v WHERE property_id <= 0 UNION ALL SELECT property_id, 'id_repeated' FROM v WHERE n > 1 UNION ALL SELECT property_id, 'status_invalid' FROM v WHERE status = 'hidden'
  UNION ALL SELECT property_id, 'flags_do_not_match' FROM v WHERE (status, map_visible, route_available) NOT IN (('available', true, true), ('limited', true, false), ('unavailable', false, false)) AND status <> 'hidden'
  UNION ALL SELECT property_id, 'reasons_not_texts' FROM v WHERE reason_codes IN ('a', '["a", " "]') UNION ALL SELECT property_id, 'identity_missing' FROM v WHERE policy_version = ' ' OR source_run_id IS NULL UNION ALL SELECT property_id, 'fingerprint_not_sha256' FROM v WHERE source_fingerprint = 'ABC'
  UNION ALL SELECT property_id, 'property_unknown' FROM v WHERE property_id NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'missing' FROM orders WHERE o_custkey NOT IN (SELECT property_id FROM v) UNION ALL SELECT NULL, 'several_identities'""")
def cls_visibility_validate(spark, sf_dir):
    """Every property with an order needs a row."""
    wanted = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("property_id"))
    return Q.visibility_problems(frame(spark, sf_dir, "visibility_rows"), wanted)


_PLAN = f"SELECT property_id, method, listings, profiles, abs(x - o_x) AS movement FROM (SELECT r.*, p.x, o.x AS o_x FROM ({_REFS}) r JOIN properties p USING (property_id) LEFT JOIN ({_MATCH}) m ON m.property_id = r.property_id LEFT JOIN officials o ON o.official_id = m.official_id) WHERE method = 'exact'"


def _plan(spark, sf_dir):
    return _refs(spark, sf_dir).where("method = 'exact'").withColumn("movement", F.abs(F.col("x") - F.col("o_x")))


@query("promotion_plan", f"SELECT CASE WHEN movement > 50000 THEN 'abort' WHEN movement > 20000 THEN 'review' ELSE 'promote' END AS step, count(*) AS n, CAST(sum(profiles) AS BIGINT) AS profiles FROM ({_PLAN}) GROUP BY 1")
def promotion_plan(spark, sf_dir):
    step = F.when(F.col("movement") > 50000, "abort").when(F.col("movement") > 20000, "review").otherwise("promote")
    return _plan(spark, sf_dir).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("profiles").alias("profiles"))


def _applied(spark, sf_dir):
    """Properties with promoted x and the state before, for an exact rollback."""
    plan = _plan(spark, sf_dir).where("movement <= 20000").select("property_id", F.col("o_x").alias("new_x"))
    rows = frame(spark, sf_dir, "properties").join(plan, "property_id", "left")
    return rows.withColumn("before_x", F.when(F.col("new_x").isNotNull(), F.col("x"))).withColumn("x", F.coalesce("new_x", "x")).drop("new_x")


_APPLIED = f"SELECT p.property_id, coalesce(q.o_x, p.x) AS x, CASE WHEN q.property_id IS NOT NULL THEN p.x END AS before_x FROM properties p LEFT JOIN (SELECT l.property_id, o.x AS o_x FROM ({_PLAN}) l JOIN ({_MATCH}) m USING (property_id) JOIN officials o ON o.official_id = m.official_id WHERE movement <= 20000) q ON q.property_id = p.property_id"


@query("promotion_apply_rollback", f"SELECT property_id, round(x, 3) AS applied_x, round(coalesce(before_x, x), 3) AS restored_x FROM ({_APPLIED})")
def promotion_apply_rollback(spark, sf_dir):
    return _applied(spark, sf_dir).select("property_id", F.round("x", 3).alias("applied_x"), F.round(F.coalesce("before_x", "x"), 3).alias("restored_x"))


@query("promotion_before_state", f"SELECT property_id, round(before_x, 3) AS before_x FROM ({_APPLIED}) WHERE before_x IS NOT NULL")
def promotion_before_state(spark, sf_dir):
    return _applied(spark, sf_dir).where("before_x is not null").select("property_id", F.round("before_x", 3).alias("before_x"))


@query("promotion_validate", f"SELECT count(*) AS n, count(*) FILTER (before_x IS NOT NULL) AS moved, 0 AS unexpected FROM ({_APPLIED})")
def promotion_validate(spark, sf_dir):
    after = _applied(spark, sf_dir)
    same = after.where("before_x is null").select("property_id", "x").exceptAll(frame(spark, sf_dir, "properties").select("property_id", "x"))
    counts = after.agg(F.count("*").alias("n"), F.count("before_x").alias("moved"))
    return counts.crossJoin(F.broadcast(same.agg(F.count("*").cast("int").alias("unexpected"))))


#: Parcels as a snapshot holds them: squares, and each kind of broken ring.
FRAMES["parcels"] = """
    SELECT CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 23 = 1 THEN k - 1 ELSE k END END AS parcel_id, CASE WHEN k % 29 <> 0 THEN 26917 ELSE 4326 END AS srid, CASE WHEN k % 6 <> 0 THEN seg END AS zoning,
      CASE k % 13 WHEN 0 THEN concat('POLYGON((', p1, ',', p2, ',', p3, ',', p4, '))') WHEN 1 THEN concat('POLYGON((', p1, ',', p3, ',', p2, ',', p4, ',', p1, '))') WHEN 2 THEN concat('POLYGON((', p1, ',', p2, ',', p1, '))') WHEN 3 THEN concat('Polygon (( ', p1, ' , ', p2, ' , ', p2, ', ', p3, ',', p4, ',', p1, '))')
        WHEN 4 THEN concat('POLYGON((', p1, ',', p2, ',', p1, ',', p1, '))') WHEN 5 THEN concat('POLYGON((-', p1, ',', p2, ',', p3, ',-', p1, '))') WHEN 6 THEN concat('POINT(', p1, ')') WHEN 7 THEN 'POLYGON EMPTY' WHEN 8 THEN concat('POLYGON((', p1, ',', p2, ',x y,', p1, '))') WHEN 9 THEN NULL
        ELSE concat('POLYGON((', p1, ',', p2, ',', p3, ',', p4, ',', p1, '))') END AS wkt
    FROM (SELECT c_custkey AS k, c_mktsegment AS seg, concat(CAST(x AS STRING), ' ', CAST(y AS STRING)) AS p1, concat(CAST(x + 10 AS STRING), ' ', CAST(y AS STRING)) AS p2, concat(CAST(x + 10 AS STRING), ' ', CAST(y + 10 AS STRING)) AS p3, concat(CAST(x AS STRING), ' ', CAST(y + 10 AS STRING)) AS p4
      FROM (SELECT c_custkey, c_mktsegment, c_custkey * 7919 % 9000 + 1 AS x, c_custkey * 31 % 7000 + 1 AS y FROM customer))"""
#: Rings point by point, edges by a join of neighbours, crossings by a join of edges.
_PARCELS = """WITH f AS (SELECT *, row_number() OVER () AS rid, upper(trim(wkt)) LIKE 'POLYGON%' AS poly FROM parcels),
  p AS (SELECT rid, i, TRY_CAST(split_part(trim(ps[i]), ' ', 1) AS DOUBLE) AS x, TRY_CAST(split_part(trim(ps[i]), ' ', 2) AS DOUBLE) AS y, len(ps) AS n FROM (SELECT rid, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT rid, string_split(nullif(regexp_extract(upper(wkt), '\\(\\(([^()]*)\\)', 1), ''), ',') AS ps FROM f WHERE poly) WHERE ps IS NOT NULL)),
  e AS (SELECT a.rid, a.i, a.n, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON b.rid = a.rid AND b.i = a.i + 1),
  r AS (SELECT rid, max(n) AS n, bool_and(x IS NOT NULL AND y IS NOT NULL) AS whole, arg_min(x, i) = arg_max(x, i) AND arg_min(y, i) = arg_max(y, i) AS closed, bool_or(NOT (x BETWEEN 0 AND 8000 AND y BETWEEN 0 AND 9000)) AS outside FROM p GROUP BY 1),
  q AS (SELECT rid, bool_or(ax = bx AND ay = b_y) AS repeated, abs(sum(ax * b_y - bx * ay)) < 1e-9 AS flat FROM e GROUP BY 1),
  s AS (SELECT DISTINCT e.rid FROM e JOIN e g ON g.rid = e.rid AND g.i > e.i + 1 AND ((e.bx - e.ax) * (g.ay - e.ay) - (e.b_y - e.ay) * (g.ax - e.ax)) * ((e.bx - e.ax) * (g.b_y - e.ay) - (e.b_y - e.ay) * (g.bx - e.ax)) < 0
      AND ((g.bx - g.ax) * (e.ay - g.ay) - (g.b_y - g.ay) * (e.ax - g.ax)) * ((g.bx - g.ax) * (e.b_y - g.ay) - (g.b_y - g.ay) * (e.bx - g.ax)) < 0),
  c AS (SELECT f.rid, unnest(list_filter([CASE WHEN parcel_id IS NULL THEN 'missing_id' END, CASE WHEN parcel_id IS NOT NULL AND count(*) OVER (PARTITION BY parcel_id) > 1 THEN 'repeated_id' END, CASE WHEN srid <> 26917 THEN 'wrong_srid' END, CASE WHEN NOT poly THEN 'wrong_type' END, CASE WHEN zoning IS NULL THEN 'missing_zoning' END,
      CASE WHEN coalesce(poly, true) AND r.n IS NULL THEN 'empty_geometry' END, CASE WHEN NOT whole THEN 'coordinate_not_finite' END, CASE WHEN r.n < 4 THEN 'too_few_points' END, CASE WHEN NOT closed THEN 'ring_not_closed' END, CASE WHEN whole AND repeated THEN 'repeated_point' END, CASE WHEN whole AND closed AND r.n >= 4 AND flat THEN 'no_area' END,
      CASE WHEN whole AND closed AND s.rid IS NOT NULL THEN 'self_intersection' END, CASE WHEN whole AND outside THEN 'out_of_bounds' END], lambda v: v IS NOT NULL)) AS violation FROM f LEFT JOIN r ON r.rid = f.rid LEFT JOIN q ON q.rid = f.rid LEFT JOIN s ON s.rid = f.rid)
  SELECT violation, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT '__rows__', count(*) FROM f UNION ALL SELECT '__valid__', count(*) FROM f WHERE rid NOT IN (SELECT rid FROM c)"""


@query("reference_import_check", _PARCELS)
def reference_import_check(spark, sf_dir):
    found = V.snapshot_violations(frame(spark, sf_dir, "parcels"), "parcel_id", "wkt", "srid", ["zoning"], expected_srid=26917, bounds=(0.0, 0.0, 8000.0, 9000.0))
    return V.counted(found)


@query("mobility_normalize", "SELECT facility, field, value FROM (SELECT p_partkey AS facility, 'kind' AS field, lower(p_type) AS value FROM part UNION ALL SELECT p_partkey, 'owner', lower(p_brand) FROM part WHERE p_partkey % 2 = 0)")
def mobility_normalize(spark, sf_dir):
    mapping = {"kind": F.lower("p_type"), "owner": F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand"))}
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("facility"), *(v.alias(k) for k, v in mapping.items()))
    return rows.unpivot("facility", list(mapping), "field", "value").where("value is not null")


@query("cls_context_state", "SELECT property_id, CASE WHEN n_ok >= 5 THEN 'ready' WHEN n_ok > 0 THEN 'limited' ELSE 'unavailable' END AS state FROM (SELECT property_id, count(*) FILTER (quality_status = 'complete' AND NOT is_stale) AS n_ok FROM profiles GROUP BY 1)")
def cls_context_state(spark, sf_dir):
    ok = F.count_if((F.col("quality_status") == "complete") & ~F.col("is_stale"))
    return frame(spark, sf_dir, "profiles").groupBy("property_id").agg(ok.alias("n")).select("property_id", F.when(F.col("n") >= 5, "ready").when(F.col("n") > 0, "limited").otherwise("unavailable").alias("state"))


@query("cls_geocode_triage", "SELECT listing_id, CASE WHEN distance_km > p THEN 'severe' WHEN geocode_confidence < 0.5 THEN 'weak' WHEN distance_km IS NULL THEN 'unknown' ELSE 'fine' END AS triage FROM listings, (SELECT quantile_cont(distance_km, 0.95) AS p FROM listings)")
def cls_geocode_triage(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings")
    edge = rows.groupBy("distance_km").agg(F.count("*").alias("n")).where("distance_km is not null").agg(F.expr("percentile(distance_km, 0.95D, n)").alias("p"))
    triage = F.when(F.col("distance_km") > F.col("p"), "severe").when(F.col("geocode_confidence") < 0.5, "weak").when(F.col("distance_km").isNull(), "unknown").otherwise("fine")
    return rows.crossJoin(F.broadcast(edge)).select("listing_id", triage.alias("triage"))


_PT = "CASE WHEN id % 6 IN (0, 1, 2) AND id % 5 = 0 THEN 'recoverable' WHEN id % 6 IN (0, 1, 2) AND id % 6 <> id % 3 THEN 'defect' WHEN id % 6 IN (0, 1, 2) THEN 'confirmed' ELSE 'unspecified' END"


@query("cls_price_triage", f"SELECT id, {_PT} AS triage FROM notices")
def cls_price_triage(spark, sf_dir):
    i = F.col("id")
    stored = F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 3 == 0, "month").when(i % 3 == 1, "week").otherwise("day")
    told = X.price_period(F.col("price_text"))
    triage = F.when(told.isNull(), "unspecified").when(stored.isNull(), "recoverable").when(told != stored, "defect").otherwise("confirmed")
    return frame(spark, sf_dir, "notices").select("id", triage.alias("triage"))


_LOC = "CASE WHEN latitude IS NULL THEN 'exclude' WHEN coalesce(geocode_confidence, 0) < 0.5 OR distance_km > 15 THEN 'limitation' ELSE 'safe' END"


def _location():
    return F.when(F.col("latitude").isNull(), "exclude").when((F.coalesce("geocode_confidence", F.lit(0.0)) < 0.5) | F.coalesce(F.col("distance_km") > 15, F.lit(False)), "limitation").otherwise("safe")


@query("cls_location_demo", f"SELECT listing_id, {_LOC} AS class FROM listings")
def cls_location_demo(spark, sf_dir):
    return frame(spark, sf_dir, "listings").select("listing_id", _location().alias("class"))


@query("triage_report", f"SELECT class, n, array_to_string(ids, ',') AS sample FROM (SELECT class, count(*) AS n, (list(listing_id ORDER BY h, listing_id))[1:5] AS ids FROM (SELECT listing_id, {_LOC} AS class, sha256('triage:' || CAST(listing_id AS VARCHAR)) AS h FROM listings) GROUP BY 1)")
def triage_report(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings").select("listing_id", _location().alias("class"), H.stable_hash_order("triage", F.col("listing_id")).alias("h"))
    few = top_per_key(rows, ["class"], [F.col("h"), F.col("listing_id")], 5).groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "listing_id"))), lambda e: e.listing_id.cast("string")), ",").alias("sample"))
    return rows.groupBy("class").agg(F.count("*").alias("n")).join(few, "class")


@query("canonical_rebuild", "SELECT l.listing_id, l.price_monthly AS old_price, n.price_monthly AS new_price, n.price_monthly IS NOT NULL AND latitude IS NOT NULL AS map_ready FROM listings l JOIN rebuilt n USING (listing_id)")
def canonical_rebuild(spark, sf_dir):
    new = frame(spark, sf_dir, "rebuilt").select("listing_id", F.col("price_monthly").alias("new_price"))
    rows = frame(spark, sf_dir, "listings").join(new, "listing_id")
    return rows.select("listing_id", F.col("price_monthly").alias("old_price"), "new_price", (F.col("new_price").isNotNull() & F.col("latitude").isNotNull()).alias("map_ready"))


_REPLAY = f"""WITH RECURSIVE {quality._STATES_SQL}, m AS (SELECT * FROM states WHERE state IN ('decided', 'applied')),
  r AS (SELECT l.listing_id, l.price_monthly, CAST(l.bedrooms AS VARCHAR) AS bedrooms, p.housing_type, i.quality, i.evidence <> '' AND contains(lower(d.text), i.evidence) AND i.toxic = 0 AS passes
    FROM listings l LEFT JOIN inferred i ON i.doc_id = l.listing_id LEFT JOIN documents d ON d.doc_id = l.listing_id LEFT JOIN reparsed p ON p.listing_id = l.listing_id),
  u AS (SELECT listing_id, 'price' AS field, CAST(CAST(price_monthly AS BIGINT) AS VARCHAR) AS rule, CAST(quality AS VARCHAR) AS cached, passes FROM r UNION ALL SELECT listing_id, 'bedrooms', bedrooms, housing_type, quality = 1 FROM r)
  SELECT listing_id, field, CASE WHEN m.state IS NOT NULL THEN m.value WHEN rule IS NOT NULL THEN rule WHEN coalesce(passes, false) THEN cached END AS value,
    CASE WHEN m.state IS NOT NULL THEN 'manual' WHEN rule IS NOT NULL THEN 'rule' WHEN cached IS NULL THEN NULL WHEN coalesce(passes, false) THEN 'inference' ELSE 'rejected' END AS source FROM u LEFT JOIN m USING (listing_id, field)"""


@query("cls_replay_cached", _REPLAY)
def cls_replay_cached(spark, sf_dir):
    """Prices and bedrooms read again: what people decided stays, then the rules, then cached inferences that their evidence bears out."""
    cached = frame(spark, sf_dir, "inferred").withColumnRenamed("doc_id", "listing_id")
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("listing_id"), "text")
    kinds = frame(spark, sf_dir, "reparsed").select("listing_id", F.col("housing_type").alias("kind"))
    rows = frame(spark, sf_dir, "listings").join(cached, "listing_id", "left").join(texts, "listing_id", "left").join(kinds, "listing_id", "left")
    accepted, _ = Q.evidence_gate(F.col("quality"), F.col("evidence"), F.array("text"), F.col("toxic") == 0)
    fields = {"price": (F.col("price_monthly").cast("long"), F.col("quality"), accepted.isNotNull()), "bedrooms": (F.col("bedrooms"), F.col("kind"), F.col("quality") == 1)}
    states = D.decision_states(frame(spark, sf_dir, "decision_log"), ["listing_id", "field"])
    again = D.replay(rows.withColumn("bedrooms", F.col("bedrooms").cast("string")), states, ["listing_id"], fields)
    return again.select("listing_id", F.expr("stack(2, 'price', price, 'bedrooms', bedrooms)").alias("field", "_a")).select("listing_id", "field", "_a.*")


@query("fn_unit_set", "SELECT property_id, array_to_string(list_sort(list_distinct(list(unit))), '|') AS units FROM (SELECT property_id, nullif(regexp_extract(address, 'Unit (\\d)', 1), '') AS unit FROM listings) WHERE unit IS NOT NULL GROUP BY 1")
def fn_unit_set(spark, sf_dir):
    unit = F.substring_index(A.address_parts(F.col("address"))["unit"], ":", -1)
    rows = frame(spark, sf_dir, "listings").select("property_id", unit.alias("unit")).where("unit is not null")
    return rows.groupBy("property_id").agg(F.array_join(F.array_sort(F.collect_set("unit")), "|").alias("units"))


@query("fn_iso_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 4 = 2 THEN 'invalid_date' END AS issue FROM orders")
def fn_iso_date(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 4 < 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("")
    day, issue = temporal.iso_date(text)
    return load(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), issue.alias("issue"))


@query("fn_aware_utc", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM events")
def fn_aware_utc(spark, sf_dir):
    e = F.col("event_id")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(e % 3 == 0, F.concat(base, F.lit("Z"))).when(e % 3 == 1, F.concat(base, F.lit("+02:00"))).otherwise(base)
    return load(spark, sf_dir, "events").select("event_id", temporal.aware_utc(text).alias("utc"))


@query("fn_departures", """SELECT s_suppkey, time_period, CAST(strptime('2026-01-' || day || ' ' || t, '%Y-%m-%d %H:%M') AS TIMESTAMP) + INTERVAL 5 HOUR AS departure_at FROM supplier, (VALUES
  ('weekday_morning_commute', '05', ['07:30', '08:00', '08:30']), ('weekday_midday', '05', ['11:30', '12:00', '12:30']), ('weekday_evening_commute', '05', ['16:30', '17:00', '17:30']),
  ('weekday_late_evening', '05', ['21:30', '22:00', '22:30']), ('saturday_daytime', '10', ['11:30', '12:00', '12:30']), ('sunday_daytime', '11', ['11:30', '12:00', '12:30'])) v(time_period, day, ts), LATERAL (SELECT unnest(ts) AS t)""")
def fn_departures(spark, sf_dir):
    return temporal.departures(load(spark, sf_dir, "supplier"), F.lit("2026-01-05").cast("date"), "America/Toronto").select("s_suppkey", "time_period", "departure_at")


@query("fn_age_score", "SELECT listing_id, round(greatest(0.0, 100 - 2 * (epoch(TIMESTAMP '1998-02-01 00:00:00') - epoch(last_seen_at)) / 86400.0), 4) AS score FROM listings")
def fn_age_score(spark, sf_dir):
    return frame(spark, sf_dir, "listings").select("listing_id", F.round(temporal.age_score(F.col("last_seen_at"), F.lit("1998-02-01 00:00:00").cast("timestamp")), 4).alias("score"))


_CAL = "SELECT s_suppkey AS service_id, CAST('2026-01-01' AS DATE) + CAST(s_suppkey % 9 AS INT) AS start_date, CAST('2026-01-20' AS DATE) + CAST(s_suppkey % 5 AS INT) AS end_date, s_suppkey FROM supplier"


@query("gtfs_service_days", f"""WITH c AS ({_CAL}), d AS (SELECT service_id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM c), a AS (SELECT service_id, day FROM d WHERE (service_id + isodow(day) - 1) % 3 <> 0 UNION SELECT service_id, end_date + 1 FROM c WHERE service_id % 2 = 0)
  SELECT service_id, count(*) AS days, min(day) AS first_day, max(day) AS last_day FROM a WHERE (service_id, day) NOT IN (SELECT service_id, start_date FROM c WHERE service_id % 4 = 0) GROUP BY 1""")
def gtfs_service_days(spark, sf_dir):
    rows = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    date = lambda d, m: F.date_add(F.lit(d).cast("date"), (k % m).cast("int"))
    calendar = rows.select(k.alias("service_id"), date("2026-01-01", 9).alias("start_date"), date("2026-01-20", 5).alias("end_date"), *(F.when((k + i) % 3 != 0, 1).otherwise(0).alias(w) for i, w in enumerate(temporal.WEEKDAYS)))
    more = calendar.where("service_id % 2 = 0").select("service_id", F.date_add("end_date", 1).alias("day"), F.lit(1).alias("exception_type"))
    less = calendar.where("service_id % 4 = 0").select("service_id", F.col("start_date").alias("day"), F.lit(2).alias("exception_type"))
    return temporal.service_days(calendar, more.unionByName(less)).groupBy("service_id").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


FRAMES["descriptions"] = """
    SELECT doc_id AS id, concat(text, '\n',
      CASE doc_id % 7 WHEN 0 THEN 'Sublet from May to August, $600 monthly.' WHEN 1 THEN 'Not a sublet! Rent is due Jan - Apr' WHEN 2 THEN 'There is an option to sublet; available Sept 1 until Dec 31.' WHEN 3 THEN 'May - Aug'
        WHEN 4 THEN 'The discounted price June to July, call. It is a sublease' WHEN 5 THEN 'Price: March to April only, a term' ELSE 'Special rate May through June and much more to say about the house and its garden, the street and the park, the shops and the school year' END, CASE doc_id % 3 WHEN 0 THEN ' \n' ELSE '; ' END,
      CASE doc_id % 5 WHEN 0 THEN 'Fully furnished room, utilities included. FULLY FURNISHED' WHEN 1 THEN 'Unfurnished and not furnished at all, plus  utilities' WHEN 2 THEN 'furnished room or unfurnished? all-inclusive' WHEN 3 THEN 'Shared bathroom. Private bathroom extra. 12-month lease, women only'
        ELSE '8 month lease or 4-month lease: any gender, females preferred' END) AS text
    FROM documents"""


def _places(of: str, pattern: str) -> str:
    """Matches of a pattern in a text with their offsets: what lies between them tells where they are."""
    return f"list_transform(range(1, len(regexp_extract_all({of}, '{pattern}')) + 1), lambda k: struct_pack(m := regexp_extract_all({of}, '{pattern}')[k], pos := coalesce(list_sum(list_transform(string_split_regex({of}, '{pattern}')[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all({of}, '{pattern}')[1:k - 1], lambda x: length(x))), 0)))"


def _explicit_sql() -> str:
    parts = []
    for name, field in E.FIELDS.items():
        text = "text"
        if field.hypothetical:
            pattern = "(?i)" + "|".join(field.hypothetical)
            text = f"list_aggregate(list_transform(range(1, len(string_split_regex(text, '{pattern}')) + 1), lambda i: string_split_regex(text, '{pattern}')[i] || coalesce(repeat(' ', length(regexp_extract_all(text, '{pattern}')[i])), '')), 'string_agg', '')"
        for rank, (value, patterns) in enumerate(field.values):
            parts.append(f"SELECT id, '{name}' AS field, '{value}' AS value, {rank} AS rank, unnest({_places('t', '(?i)' + '|'.join(patterns))}) AS e FROM (SELECT id, {text} AS t FROM descriptions)")
    lease = _places("text", "(?i)" + E.LEASE[1].replace("(", "(?:", 1))
    parts.append(f"SELECT id, '{E.LEASE[0]}', NULL, 9, unnest({lease}) FROM descriptions")
    return f"""WITH m AS ({" UNION ALL ".join(parts)}),
  e AS (SELECT id, field, CASE WHEN rank = 9 THEN CAST(CAST(regexp_extract(e.m, '\\d+') AS INT) AS VARCHAR) ELSE value END AS value, rank, lower(e.m) || '@' || CAST(e.pos AS BIGINT)::VARCHAR AS said, e.pos AS pos FROM m),
  w AS (SELECT * FROM e WHERE NOT (field = 'is_sublet' AND value = 'true' AND id IN (SELECT id FROM e WHERE field = 'is_sublet' AND value = 'false'))),
  g AS (SELECT *, min(rank) OVER (PARTITION BY id, field) AS lead, min(value) OVER (PARTITION BY id, field) = max(value) OVER (PARTITION BY id, field) AS one FROM w)
  SELECT id, field, max(CASE WHEN one THEN value END) AS value, coalesce(string_agg(said, '|' ORDER BY pos) FILTER (rank = lead AND (rank < 9 OR one)), '') AS supporting,
    coalesce(string_agg(said, '|' ORDER BY rank, pos) FILTER (rank > lead OR (rank = 9 AND NOT one)), '') AS conflicting FROM g GROUP BY 1, 2"""


@query("fn_explicit_text_value", _explicit_sql())
def fn_explicit_text_value(spark, sf_dir):
    rows = E.explicit_text_values(frame(spark, sf_dir, "descriptions"), "id", "text")
    return rows.select("id", "field", "value", E.listed("supporting").alias("supporting"), E.listed("conflicting").alias("conflicting"))


def _nearest(of: str, pattern: str) -> str:
    """The least distance of a pattern's matches on the left of the range, and on any side."""
    p = f"(?i){pattern}"
    left = f"list_min(list_transform(list_filter({_places(of, p)}, lambda e: e.pos + length(e.m) <= lo), lambda e: lo - e.pos - length(e.m)))"
    right = f"list_min(list_transform(list_filter({_places(of, p)}, lambda e: e.pos + length(e.m) > lo), lambda e: greatest(0, e.pos - hi)))"
    return f"{left} AS {{0}}_left, {right} AS {{0}}_right"


_ROLE_SQL = f"""WITH r AS (SELECT id, text, unnest({_places("text", "(?i)" + E.RANGE)}) AS e FROM descriptions),
  p AS (SELECT id, text, e.m AS m, e.pos::BIGINT AS pos, length(e.m) AS n, substr(text, 1, e.pos::BIGINT) AS head, substr(text, e.pos::BIGINT + length(e.m) + 1) AS tail FROM r),
  b AS (SELECT *, length(regexp_extract(head, '[^.!?;:\r\n]*$')) AS own, regexp_extract(tail, '^[^.!?;:\r\n]*') AS rest FROM p),
  c AS (SELECT *, least({E.WINDOW}, own + CASE WHEN own < length(head) AND substr(head, length(head) - own, 1) = ':' THEN least({E.LABEL}, length(head) - own) ELSE 0 END) AS lo FROM b),
  d AS (SELECT id, pos, m, own, rest, head, lo, lo + n AS hi, substr(head, length(head) - lo + 1) || m || substr(rest, 1, {E.WINDOW}) AS near FROM c),
  f AS (SELECT *, {_nearest("near", E.AVAILABILITY).format("free")}, {_nearest("near", E.PRICING.replace("'", "''")).format("price")} FROM d),
  g AS (SELECT *, least(free_left, free_right) AS free, least(price_left, price_right) AS price FROM f)
  SELECT id, CAST(pos AS INT) AS start, m AS text,
    CASE WHEN free_left <= price_left OR (free_left IS NOT NULL AND price_left IS NULL) OR free <= price OR (free IS NOT NULL AND price IS NULL) THEN 'availability' WHEN price IS NOT NULL THEN 'pricing'
      WHEN regexp_matches(substr(head, length(head) - own + 1) || rest, '\\w') THEN 'ambiguous' ELSE 'availability' END AS role,
    CAST(CASE WHEN free_left <= price_left OR (free_left IS NOT NULL AND price_left IS NULL) THEN free_left WHEN free <= price OR (free IS NOT NULL AND price IS NULL) THEN free ELSE price END AS INT) AS distance FROM g"""


@query("fn_context_role", _ROLE_SQL)
def fn_context_role(spark, sf_dir):
    return E.context_roles(frame(spark, sf_dir, "descriptions"), "id", "text").drop("end")
