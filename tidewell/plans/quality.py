"""Quality, review and comparison queries, over orders as listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import cohorts
from ..operators import decisions as D
from ..operators import quality as Q
from ..operators import sorts as O
from ..operators.lifecycle import row_fingerprint
from ..sources.readers import read_manifests
from ..sources.scratch import scratch_path
from .frames import FRAMES, frame, load
from .registry import query

# a later version of the listings, with fills, clears, changes, additions and removals
FRAMES["rebuilt"] = """
    SELECT o_orderkey AS listing_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(floor(o_totalprice / 40) + 10 AS DOUBLE) ELSE CAST(floor(o_totalprice / 40) AS DOUBLE) END AS price_monthly,
      CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 6 AS INT) ELSE 2 END AS bedrooms,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'apartment' WHEN '2' THEN 'house' WHEN '3' THEN 'townhouse' WHEN '5' THEN 'Apartment_To_Share' END AS housing_type
    FROM orders WHERE o_orderkey % 29 <> 0"""
# the semantic fields as a later parser reads them
FRAMES["reparsed"] = """
    SELECT o_orderkey AS listing_id, CASE o_orderkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'any' WHEN 2 THEN ' ' END AS preferred_gender,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'apartment' WHEN '2' THEN 'house' WHEN '3' THEN 'townhouse' WHEN '5' THEN 'apartment_to_share' END AS housing_type,
      o_orderkey % 3 = 0 AS utilities_included, CASE WHEN o_orderkey % 5 < 2 THEN true END AS furnished,
      CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS is_sublet, CASE o_orderkey % 5 WHEN 0 THEN 'summer' WHEN 2 THEN 'non_summer' WHEN 3 THEN 'fall' END AS availability_category,
      CASE o_orderkey % 5 WHEN 0 THEN 'fixed' WHEN 1 THEN 'monthly' WHEN 2 THEN 'sublet' WHEN 3 THEN 'fixed' END AS lease_type,
      CASE WHEN o_orderkey % 19 <> 0 THEN CAST(floor(o_totalprice / 40) AS DOUBLE) END AS price_monthly
    FROM orders WHERE o_orderkey % 29 <> 0"""
FRAMES["inferred"] = """
    SELECT doc_id, quality, toxic, CASE doc_id % 4 WHEN 0 THEN 'the' WHEN 1 THEN '' WHEN 2 THEN 'qqq' END AS evidence FROM labels"""
FRAMES["stages"] = """
    SELECT o_custkey AS run_id, o_orderkey AS stage_no, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, CAST(o_orderkey % 3 AS INT) AS input_rows, CAST((o_orderkey + o_custkey) % 3 AS INT) AS output_rows FROM orders"""
# what reviewers and the source did to a listing's field, in time
FRAMES["decision_log"] = """
    SELECT CAST(floor(event_id / 7) AS BIGINT) AS listing_id, CASE WHEN CAST(substr(props, 7, 1) AS INT) < 4 THEN 'price' WHEN CAST(substr(props, 7, 1) AS INT) < 7 THEN 'bedrooms' ELSE 'latitude' END AS field, ts AS happened_at, event_id,
      CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'drafted' WHEN 'purchase' THEN 'decided' WHEN 'signup' THEN 'applied' ELSE 'source_changed' END AS action, CAST(CAST(floor(value) AS BIGINT) AS STRING) AS value
    FROM events"""


def _listings(spark, sf_dir):
    return frame(spark, sf_dir, "listings")


def _flags(sql: dict[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in sql.items()) + ")"


def _row(name: str, sql: str, columns):
    """A query over listings with the id and the given columns."""

    @query(name, f"SELECT listing_id, {sql} FROM listings")
    def run(spark, sf_dir):
        return _listings(spark, sf_dir).select("listing_id", *(c.alias(n) for n, c in columns().items()))


@query("cls_promote_rules", "SELECT listing_id, coalesce(housing_type, CASE WHEN listing_id % 2 = 0 THEN 'unit' END) AS housing_type, CASE WHEN housing_type IS NULL AND listing_id % 2 = 0 THEN 'rule' WHEN listing_id % 3 = 0 THEN 'ai' END AS housing_type_source FROM listings")
def cls_promote_rules(spark, sf_dir):
    i = F.col("listing_id")
    rows = _listings(spark, sf_dir).withColumns({"housing_type_rule": F.when(i % 2 == 0, "unit"), "housing_type_source": F.when(i % 3 == 0, "ai")})
    return Q.promote_rules(rows, ["housing_type"]).select("listing_id", "housing_type", "housing_type_source")


_row("cls_needs_inference", _flags({"lease": "lease_type IS NULL AND is_sublet IS NULL", "people": "preferred_gender IS NULL AND pet_policy IS NULL", "comfort": "furnished IS NULL AND laundry IS NULL"}) + " AS unresolved",
     lambda: dict(unresolved=F.array_join(Q.unresolved_groups({"lease": ("lease_type", "is_sublet"), "people": ("preferred_gender", "pet_policy"), "comfort": ("furnished", "laundry")}), "|")))
_row("cls_validate_flags", _flags({"sublet_with_fixed_lease": "is_sublet AND lower(lease_type) = 'fixed'", "utilities_conflict": "utilities_included AND contains(title, 'machinery')", "furnished_conflict": "NOT furnished AND contains(coalesce(amenities, ''), 'gym')", "parking_conflict": "NOT parking_available AND contains(coalesce(amenities, ''), 'parking')", "price_out_of_range": "price_monthly NOT BETWEEN 250 AND 3500"}) + " AS flags",
     lambda: dict(flags=F.array_join(Q.contradiction_flags(), "|")))
_row("cls_precedence", "coalesce(CASE WHEN listing_id % 5 = 0 THEN 'manual' END, CASE WHEN listing_id % 3 = 0 THEN 'rule' END, housing_type) AS value, CASE WHEN listing_id % 5 = 0 THEN 'manual' WHEN listing_id % 3 = 0 THEN 'rule' WHEN housing_type IS NOT NULL THEN 'canonical' END AS source",
     lambda: dict(zip(("value", "source"), Q.precedence(F.when(F.col("listing_id") % 5 == 0, "manual"), F.when(F.col("listing_id") % 3 == 0, "rule"), F.col("housing_type")), strict=True)))
_QC = {"geocode_status_missing": "latitude IS NULL", "missing_lat_lng": "latitude IS NULL", "city_level_only": "listing_id % 9 = 0", "city_mismatch": "listing_id % 14 = 0", "country_mismatch": "listing_id % 21 = 0", "low_confidence": "geocode_confidence IS NULL OR geocode_confidence < 0.8", "far_from_centre": "distance_km > 15"}
_QC_ISSUES = _flags(_QC)


def _qc():
    i = F.col("listing_id")
    return Q.geocode_qc(F.when(F.col("latitude").isNotNull(), "ok"), F.col("latitude"), F.when(i % 9 == 0, "city"), F.when(i % 14 == 0, "toronto").otherwise("london"), F.when(i % 21 != 0, "ca"), F.col("geocode_confidence"), F.col("distance_km"), 0.8, 15.0)


_row("cls_geocode_qc", f"{_QC_ISSUES} AS issues, {_QC_ISSUES} IN ('', 'far_from_centre') AS map_ready", lambda: dict(issues=F.array_join(_qc()[1], "|"), map_ready=_qc()[0]))
_SCORE = "CASE WHEN price_monthly IS NULL THEN least(s, 55.0) ELSE s END"
_REQ = ("listing_id", "price_monthly", "housing_type", "bedrooms", "lease_type")
_KNOWN = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in _REQ)


@query("cls_data_quality", f"SELECT listing_id, round({_SCORE}, 3) AS score, CASE WHEN price_monthly IS NULL THEN 'needs-review' WHEN s >= 85 THEN 'confirmed' ELSE 'parsed' END AS status FROM (SELECT *, ({_KNOWN}) / 5e0 * 70 + CASE WHEN location_map_visible THEN 20 ELSE 0 END + coalesce(least(10.0, greatest(0.0, geocode_confidence * 10)), 0) AS s FROM listings)")
def cls_data_quality(spark, sf_dir):
    score, status = Q.data_quality(_REQ, F.col("location_map_visible"), F.col("geocode_confidence"), F.col("price_monthly").isNull())
    return _listings(spark, sf_dir).select("listing_id", F.round(score, 3).alias("score"), status.alias("status"))


_row("cls_field_quality", "CASE WHEN housing_type IS NULL THEN 'unknown' WHEN listing_id % 4 = 0 THEN 'human-reviewed' WHEN listing_id % 4 = 1 THEN 'AI-assisted' WHEN listing_id % 4 = 2 THEN 'parsed' ELSE 'confirmed' END AS quality",
     lambda: dict(quality=Q.field_quality(F.col("housing_type"), F.when(F.col("listing_id") % 4 == 0, "Manual fix").when(F.col("listing_id") % 4 == 1, "ai:v2").when(F.col("listing_id") % 4 == 2, "rule"))))


@query("cls_evidence_gate", "SELECT i.doc_id, CASE WHEN evidence <> '' AND contains(lower(text), evidence) AND quality = 1 THEN quality END AS accepted, NOT coalesce(evidence <> '' AND contains(lower(text), evidence) AND quality = 1, false) AS blocked FROM inferred i JOIN documents d ON d.doc_id = i.doc_id")
def cls_evidence_gate(spark, sf_dir):
    rows = frame(spark, sf_dir, "inferred").join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    accepted, blocked = Q.evidence_gate(F.col("quality"), F.col("evidence"), F.array("text"), F.col("quality") == 1)
    return rows.select("doc_id", accepted.alias("accepted"), blocked.alias("blocked"))


@query("cls_consensus", "SELECT a.conv_id, CASE WHEN a.n IS NOT DISTINCT FROM b.n THEN a.n END AS n, a.n IS DISTINCT FROM b.n AS disagree FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) a JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY 1) b ON a.conv_id = b.conv_id")
def cls_consensus(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    count = lambda test: turns.where(test).groupBy("conv_id").agg(F.count("*").alias("n"))
    return Q.consensus(count("role = 'user'"), count("role <> 'user'"), "conv_id", "n")


_DIFF = """WITH f AS (SELECT coalesce(o.listing_id, n.listing_id) AS listing_id, o.listing_id IS NULL AS added, n.listing_id IS NULL AS gone, v.field, CASE v.field WHEN 'bedrooms' THEN CAST(o.bedrooms AS VARCHAR) ELSE o.housing_type END AS before, CASE v.field WHEN 'bedrooms' THEN CAST(n.bedrooms AS VARCHAR) ELSE n.housing_type END AS after
  FROM (SELECT * FROM listings WHERE listing_id % 31 <> 0) o FULL JOIN rebuilt n ON n.listing_id = o.listing_id, (VALUES ('bedrooms'), ('housing_type')) v(field))
  SELECT listing_id, field, before, after, CASE WHEN added THEN 'added' WHEN gone THEN 'removed' WHEN before IS NULL THEN 'filled' WHEN after IS NULL THEN 'cleared' ELSE 'changed' END AS change FROM f WHERE before IS DISTINCT FROM after"""


def _diff(spark, sf_dir):
    return Q.field_changes(_listings(spark, sf_dir).where("listing_id % 31 <> 0"), frame(spark, sf_dir, "rebuilt"), "listing_id", ["bedrooms", "housing_type"])


query("join_full_outer_diff", _DIFF)(_diff)


@query("agg_stability_report", f"SELECT field, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change IN ('filled', 'cleared')) AS filled_or_cleared, count(*) FILTER (change IN ('added', 'removed')) AS added_or_removed, count(*) FILTER (change = 'cleared') = 0 AS passes FROM ({_DIFF}) GROUP BY 1")
def agg_stability_report(spark, sf_dir):
    c = F.col("change")
    return _diff(spark, sf_dir).groupBy("field").agg(F.count_if(c == "changed").alias("changed"), F.count_if(c.isin("filled", "cleared")).alias("filled_or_cleared"), F.count_if(c.isin("added", "removed")).alias("added_or_removed"), (F.count_if(c == "cleared") == 0).alias("passes"))


@query("candidate_run_compare", f"SELECT change, count(*) AS n, count(DISTINCT listing_id) AS listings FROM ({_DIFF}) GROUP BY 1")
def candidate_run_compare(spark, sf_dir):
    return _diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"), F.countDistinct("listing_id").alias("listings"))


# the fields whose labels are counted, and three that follow from others
_SEMANTIC = ("preferred_gender", "housing_type", "utilities_status", "utilities_included", "furnished", "is_sublet", "availability_category", "lease_type", "lease_term_months", "price_period", "price_monthly")
_FOLLOWING = {
    "utilities_status": "CASE WHEN utilities_included THEN 'included' WHEN NOT utilities_included THEN 'extra' END",
    "lease_term_months": "CASE lower(lease_type) WHEN 'fixed' THEN 12 WHEN 'sublet' THEN 4 WHEN 'monthly' THEN 1 END",
    "price_period": "CASE WHEN price_monthly IS NOT NULL THEN 'month' END",
}


def _label_sql(table: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce(nullif(trim(CAST({_FOLLOWING.get(f, f)} AS VARCHAR)), ''), '<unknown>') AS value FROM {table}" for f in _SEMANTIC)
    return f"SELECT field, value, count(*) AS n FROM ({each}) GROUP BY 1, 2"


@query("agg_scope_profile_counts", f"SELECT coalesce(a.field, b.field) AS field, coalesce(a.value, b.value) AS value, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new FROM ({_label_sql('listings')}) a FULL JOIN ({_label_sql('reparsed')}) b ON a.field = b.field AND a.value = b.value")
def agg_scope_profile_counts(spark, sf_dir):
    old, new = (frame(spark, sf_dir, n).withColumns({f: F.expr(x) for f, x in _FOLLOWING.items()}) for n in ("listings", "reparsed"))
    return Q.label_counts(old, new, _SEMANTIC)


@query("join_identity_checked", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'only_right' WHEN b.id IS NULL THEN 'only_left' WHEN a.n > 1 OR b.n > 1 THEN 'repeated' END AS problem FROM (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS id, 1 AS n FROM customer WHERE c_custkey % 4 <> 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.n > 1")
def join_identity_checked(spark, sf_dir):
    left = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return Q.identity_violations(left, load(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id")), "id")


@query("join_left_detail", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON c_custkey = o_custkey")
def join_left_detail(spark, sf_dir):
    detail = load(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return load(spark, sf_dir, "orders").join(detail, "o_custkey", "left").select("o_orderkey", "c_mktsegment")


_CACHE = "SELECT address, max(latitude) AS latitude, max(geocode_confidence) AS confidence FROM listings WHERE property_id % 3 <> 0 GROUP BY 1"
_CACHED = "CASE WHEN c.address IS NULL THEN 'miss' WHEN c.latitude IS NULL THEN 'no_coordinate' WHEN c.confidence < 0.95 THEN 'low_confidence' ELSE 'hit' END"


def _cached(spark, sf_dir):
    rows = _listings(spark, sf_dir)
    cache = rows.where("property_id % 3 <> 0").groupBy("address").agg(F.max("latitude").alias("c_lat"), F.max("geocode_confidence").alias("c_conf")).withColumn("c_hit", F.lit(True))
    result = F.when(F.col("c_hit").isNull(), "miss").when(F.col("c_lat").isNull(), "no_coordinate").when(F.col("c_conf") < 0.95, "low_confidence").otherwise("hit")
    return rows.join(cache, "address", "left").withColumn("result", result)


# geocodes of an earlier run: some listings are new since, some moved to another URL, some have another address
_EARLIER = """SELECT listing_id, concat('https://host/', source_listing_id, CASE WHEN listing_id % 29 = 0 THEN '?old' ELSE '' END) AS listing_url,
  CASE WHEN property_id % 11 = 0 THEN concat(lower(address), ', ontario') ELSE lower(address) END AS geocode_query, CASE WHEN latitude IS NULL THEN 'missing_address' ELSE 'ok' END AS geocode_status, latitude FROM listings WHERE last_seen_at < DATE '1997-01-01'"""


@query("join_cached_compatible", f"""SELECT l.listing_id, r.decision, CASE WHEN r.decision = 'reused' THEN r.latitude END AS latitude FROM listings l JOIN (
  SELECT l.listing_id, CASE WHEN e.listing_id IS NULL THEN 'rejected: not cached' WHEN concat('https://host/', l.source_listing_id) <> e.listing_url THEN 'rejected: source URL' WHEN lower(l.address) <> e.geocode_query THEN 'rejected: normalized address' WHEN e.geocode_status = 'missing_address' THEN 'missing' ELSE 'reused' END AS decision, e.latitude
  FROM listings l LEFT JOIN ({_EARLIER}) e ON e.listing_id = l.listing_id) r ON r.listing_id = l.listing_id""")
def join_cached_compatible(spark, sf_dir):
    rows = _listings(spark, sf_dir)
    earlier = spark.sql(_EARLIER.replace("FROM listings", "FROM {rows}"), rows=rows)
    now = rows.select("listing_id", F.concat(F.lit("https://host/"), "source_listing_id").alias("listing_url"), "address")
    return Q.reuse_geocodes(now, earlier, "listing_id", ["latitude"]).select("listing_id", "decision", "latitude")


@query("cls_cache_refresh", f"SELECT {_CACHED} AS result, count(*) AS n FROM listings l LEFT JOIN ({_CACHE}) c ON c.address = l.address GROUP BY 1")
def cls_cache_refresh(spark, sf_dir):
    return _cached(spark, sf_dir).groupBy("result").agg(F.count("*").alias("n"))


@query("recovered_address_geocode", f"SELECT DISTINCT l.address FROM listings l LEFT JOIN ({_CACHE}) c ON c.address = l.address WHERE c.address IS NULL ORDER BY l.address LIMIT 100")
def recovered_address_geocode(spark, sf_dir):
    return _cached(spark, sf_dir).where("result = 'miss'").select("address").distinct().orderBy("address").limit(100)


# what the geocoder said of each listing, and the cache by query
_GEOCODED = """SELECT listing_id, address, CASE WHEN listing_id % 12 = 0 THEN 'elsewhere' ELSE lower(address) END AS geocode_query, latitude, longitude, geocode_confidence, CASE WHEN listing_id % 14 = 0 THEN 'error' ELSE 'ok' END AS geocode_status,
  CASE WHEN bedrooms IS NULL THEN 'street' ELSE 'building' END AS geocode_result_type, CASE WHEN rental_structure IS NULL THEN 'inner_part' ELSE 'full_match' END AS geocode_match_type FROM listings"""
_CANDIDATES = """SELECT lower(address) AS query, CASE WHEN property_id % 5 = 0 THEN 'other' END AS provider, latitude, longitude, geocode_confidence, CASE WHEN listing_id % 14 = 0 THEN 'error' ELSE 'ok' END AS geocode_status FROM listings WHERE listing_status = 'relisted'"""
_RESOLVED = f"""SELECT g.listing_id, CASE WHEN coalesce(trim(g.address), '') = '' OR lower(g.address) <> g.geocode_query THEN 'geocode_address_query_mismatch' WHEN coalesce(c.n, 0) > 1 THEN 'geocode_multiple_cached_candidates' WHEN c.n IS NULL THEN 'geocode_cache_evidence_missing' WHEN coalesce(c.provider, 'first') <> 'first' THEN 'geocode_provider_mismatch'
  WHEN c.latitude IS DISTINCT FROM g.latitude OR c.longitude IS DISTINCT FROM g.longitude OR c.geocode_confidence IS DISTINCT FROM g.geocode_confidence OR c.geocode_status IS DISTINCT FROM g.geocode_status THEN 'geocode_cache_result_mismatch' WHEN NOT coalesce(g.latitude BETWEEN 42.95 AND 43.08 AND g.longitude BETWEEN -81.4 AND -81.15, false) THEN 'geocode_outside_bounds'
  WHEN NOT coalesce(g.geocode_confidence >= 0.3, false) THEN 'geocode_confidence_below_threshold' WHEN g.geocode_status <> 'ok' THEN 'geocode_status_not_ok' WHEN g.geocode_result_type <> 'building' THEN 'geocode_property_precision_required' WHEN g.geocode_match_type <> 'full_match' THEN 'geocode_full_match_required' ELSE 'cached_geocode_verified' END AS reason
  FROM ({_GEOCODED}) g LEFT JOIN (SELECT query, count(*) AS n, min(provider) AS provider, min(latitude) AS latitude, min(longitude) AS longitude, min(geocode_confidence) AS geocode_confidence, min(geocode_status) AS geocode_status FROM ({_CANDIDATES}) GROUP BY 1) c ON c.query = g.geocode_query"""


@query("cls_geocode_resolution", f"SELECT listing_id, reason = 'cached_geocode_verified' AS accepted, reason FROM ({_RESOLVED})")
def cls_geocode_resolution(spark, sf_dir):
    rows, cache = (spark.sql(x.replace("FROM listings", "FROM {rows}"), rows=_listings(spark, sf_dir)) for x in (_GEOCODED, _CANDIDATES))
    found = Q.geocode_resolution(rows, cache, "first", (42.95, 43.08), (-81.4, -81.15), 0.3)
    return found.select("listing_id", (F.col("reason") == "cached_geocode_verified").alias("accepted"), "reason")


@query("agg_status_counts", "SELECT coalesce(housing_type, 'unknown') AS label, count(*) AS n FROM listings GROUP BY 1")
def agg_status_counts(spark, sf_dir):
    return G.status_counts(_listings(spark, sf_dir), F.col("housing_type"))


_RUN = {"missing_price": "price_monthly IS NULL", "low_price": "price_monthly < 100", "high_price": "price_monthly > 10000", "low_confidence": "coalesce(geocode_confidence, 0) < 0.8", "not_mapped": "NOT location_map_visible", "review": "data_quality_status = 'needs-review'"}


def _run_counts(spark, sf_dir):
    p = F.col("price_monthly")
    tests = {"missing_price": p.isNull(), "low_price": p < 100, "high_price": p > 10000, "low_confidence": F.coalesce("geocode_confidence", F.lit(0.0)) < 0.8, "not_mapped": ~F.col("location_map_visible"), "review": F.col("data_quality_status") == "needs-review"}
    return G.conditional_counts(_listings(spark, sf_dir), tests)


_RUN_SQL = "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({t}) AS {n}" for n, t in _RUN.items()) + " FROM listings"
query("agg_run_summary", _RUN_SQL)(_run_counts)


@query("cls_material_warnings", f"SELECT condition, n FROM (UNPIVOT ({_RUN_SQL}) ON {', '.join(_RUN)} INTO NAME condition VALUE n) WHERE n > 0")
def cls_material_warnings(spark, sf_dir):
    return _run_counts(spark, sf_dir).unpivot([], list(_RUN), "condition", "n").where("n > 0")


@query("agg_distinct_shared", "SELECT address, count(DISTINCT property_id) AS properties FROM listings GROUP BY 1 HAVING count(DISTINCT property_id) > 1")
def agg_distinct_shared(spark, sf_dir):
    return _listings(spark, sf_dir).groupBy("address").agg(F.countDistinct("property_id").alias("properties")).where("properties > 1")


@query("agg_filtered_counts", "SELECT property_id, count(*) FILTER (travel_mode = 'walking') AS walking, count(*) FILTER (travel_mode = 'walking' AND result_type = 'exact_route') AS walking_exact, count(*) FILTER (travel_mode = 'transit') AS transit FROM profiles GROUP BY 1")
def agg_filtered_counts(spark, sf_dir):
    m, exact = F.col("travel_mode"), F.col("result_type") == "exact_route"
    return frame(spark, sf_dir, "profiles").groupBy("property_id").agg(F.count_if(m == "walking").alias("walking"), F.count_if((m == "walking") & exact).alias("walking_exact"), F.count_if(m == "transit").alias("transit"))


@query("agg_json_distinct", "SELECT property_id, array_to_string(list(DISTINCT housing_type ORDER BY housing_type), '|') AS kinds FROM listings WHERE housing_type IS NOT NULL GROUP BY 1")
def agg_json_distinct(spark, sf_dir):
    return _listings(spark, sf_dir).where("housing_type is not null").groupBy("property_id").agg(F.array_join(F.sort_array(F.collect_set("housing_type")), "|").alias("kinds"))


@query("agg_state_fingerprint", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(CAST(sum(CAST(('0x' || substr(md5(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)), 1, 12))::BIGINT AS HUGEINT)) AS HUGEINT) AS VARCHAR) AS fingerprint FROM orders")
def agg_state_fingerprint(spark, sf_dir):
    return Q.table_fingerprint(load(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("agg_dependency_impact", "SELECT l.property_id % 20 AS cohort, count(DISTINCT l.property_id) AS properties, count(*) AS listings, CAST(sum(p.n) AS BIGINT) AS profiles FROM listings l JOIN (SELECT property_id, count(*) AS n FROM profiles GROUP BY 1) p USING (property_id) GROUP BY 1")
def agg_dependency_impact(spark, sf_dir):
    counts = frame(spark, sf_dir, "profiles").groupBy("property_id").agg(F.count("*").alias("n"))
    rows = _listings(spark, sf_dir).join(counts, "property_id").withColumn("cohort", F.col("property_id") % 20)
    return rows.groupBy("cohort").agg(F.countDistinct("property_id").alias("properties"), F.count("*").alias("listings"), F.sum("n").alias("profiles"))


_BASE = "lower(regexp_replace(address, ' Unit [0-9]+', ''))"
_UNIT = "coalesce(nullif(regexp_extract(address, ' Unit ([0-9]+)', 1), ''), CASE WHEN rental_structure = 'room' THEN 'room ' || CAST(bedrooms AS STRING) END)"


@query("agg_coordinate_conflict", f"""SELECT 'several_addresses' AS conflict, concat(CAST(CAST(floor(latitude * 1e6 + 0.5) AS BIGINT) AS STRING), ',', CAST(CAST(floor(longitude * 1e6 + 0.5) AS BIGINT) AS STRING)) AS place, count(DISTINCT {_BASE}) AS n FROM listings WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 2 HAVING count(DISTINCT {_BASE}) > 1
  UNION ALL SELECT 'unit_presence_differs', {_BASE}, count(DISTINCT {_UNIT}) FROM listings GROUP BY 2 HAVING bool_or({_UNIT} IS NULL) AND bool_or({_UNIT} IS NOT NULL)""")
def agg_coordinate_conflict(spark, sf_dir):
    rows = _listings(spark, sf_dir).select("latitude", "longitude", F.expr(_BASE).alias("address"), F.expr(_UNIT).alias("unit"))
    return Q.property_conflicts(rows)


_ISSUES = "SELECT listing_id, 'missing' AS category, 'price' AS field, 'null' AS reason FROM listings WHERE price_monthly IS NULL UNION ALL SELECT listing_id, 'missing', 'bedrooms', 'null' FROM listings WHERE bedrooms IS NULL UNION ALL SELECT listing_id, 'geocode', 'latitude', 'low_confidence' FROM listings WHERE geocode_confidence < 0.3"


def _issues(spark, sf_dir):
    one = lambda c, f, r: F.struct(F.lit(c).alias("category"), F.lit(f).alias("field"), F.lit(r).alias("reason"))
    found = F.filter(F.array(F.when(F.col("price_monthly").isNull(), one("missing", "price", "null")), F.when(F.col("bedrooms").isNull(), one("missing", "bedrooms", "null")), F.when(F.col("geocode_confidence") < 0.3, one("geocode", "latitude", "low_confidence"))), lambda x: x.isNotNull())
    return _listings(spark, sf_dir).select("listing_id", F.explode(found).alias("i")).select("listing_id", "i.*")


query("cls_discover_issues", _ISSUES)(_issues)


@query("agg_review_items", f"SELECT listing_id, string_agg(DISTINCT category, '|' ORDER BY category) AS category, string_agg(DISTINCT field, '|' ORDER BY field) AS field, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reason FROM ({_ISSUES}) GROUP BY 1")
def agg_review_items(spark, sf_dir):
    return Q.review_items(_issues(spark, sf_dir), "listing_id")


@query("agg_review_index", f"SELECT category, field, CAST(floor(listing_id / 10000) AS BIGINT) AS block, count(*) AS n, string_agg(CAST(listing_id AS VARCHAR), '|' ORDER BY listing_id) AS ids FROM ({_ISSUES}) GROUP BY 1, 2, 3")
def agg_review_index(spark, sf_dir):
    return Q.review_index(_issues(spark, sf_dir), "listing_id").withColumn("ids", F.array_join("ids", "|"))


#: The log told one entry after another: each is numbered, and the state follows from the entry before.
_STATES_SQL = """e AS (SELECT *, row_number() OVER (PARTITION BY listing_id, field ORDER BY happened_at, event_id) AS k FROM decision_log WHERE action <> 'opened'),
  f AS (SELECT listing_id, field, k, 'unresolved' AS state, NULL::VARCHAR AS value, NULL::BIGINT AS decided_by, 0 AS n FROM (SELECT DISTINCT listing_id, field, 0 AS k FROM decision_log)
    UNION ALL SELECT f.listing_id, f.field, e.k, CASE e.action WHEN 'drafted' THEN 'draft' WHEN 'decided' THEN 'decided' WHEN 'source_changed' THEN CASE f.state WHEN 'unresolved' THEN 'unresolved' ELSE 'stale' END ELSE CASE f.state WHEN 'decided' THEN 'applied' ELSE f.state END END,
      CASE e.action WHEN 'decided' THEN e.value ELSE f.value END, CASE e.action WHEN 'decided' THEN e.event_id ELSE f.decided_by END, f.n + CASE e.action WHEN 'decided' THEN 1 ELSE 0 END
    FROM f JOIN e ON e.listing_id = f.listing_id AND e.field = f.field AND e.k = f.k + 1),
  states AS (SELECT listing_id, field, state, value, decided_by, greatest(n - 1, 0) AS superseded FROM f QUALIFY row_number() OVER (PARTITION BY listing_id, field ORDER BY k DESC) = 1)"""
_KEY = ["listing_id", "field"]


def _states(spark, sf_dir):
    return D.decision_states(frame(spark, sf_dir, "decision_log"), _KEY)


_PROGRESS = f"""WITH RECURSIVE {_STATES_SQL}, i AS (SELECT i.*, coalesce(state, 'unresolved') AS state FROM ({_ISSUES}) i LEFT JOIN states USING (listing_id, field)),
  b AS (SELECT * FROM i UNION ALL SELECT listing_id, '__all__', field, reason, state FROM i), l AS (SELECT category, listing_id, count(*) FILTER (state NOT IN ('decided', 'applied')) AS o FROM b GROUP BY 1, 2)
  SELECT category, count(*) AS issues, count(*) FILTER (state = 'unresolved') AS unresolved, count(*) FILTER (state = 'draft') AS draft, count(*) FILTER (state = 'decided') AS decided, count(*) FILTER (state = 'applied') AS applied, count(*) FILTER (state = 'stale') AS stale,
    count(DISTINCT listing_id) AS listings, (SELECT count(*) FROM l WHERE l.category = b.category AND o = 0) AS complete_listings, string_agg(DISTINCT field, '|' ORDER BY field) AS facets FROM b GROUP BY category"""


@query("agg_review_dashboard", _PROGRESS)
def agg_review_dashboard(spark, sf_dir):
    return D.review_dashboard(_issues(spark, sf_dir), _states(spark, sf_dir), _KEY, "listing_id", "category", "field").withColumn("facets", F.array_join("facets", "|"))


@query("sink_review_once", f"SELECT DISTINCT sha256(concat(CAST(listing_id AS VARCHAR), '|', category, '|', field)) AS review_key FROM ({_ISSUES}) WHERE listing_id % 4 <> 0")
def sink_review_once(spark, sf_dir):
    rows = _issues(spark, sf_dir).withColumn("review_key", F.sha2(F.concat_ws("|", F.col("listing_id").cast("string"), "category", "field"), 256))
    stored = rows.where("listing_id % 4 = 0").select("review_key")
    return rows.dropDuplicates(["review_key"]).join(stored, "review_key", "left_anti").select("review_key")


_DECIDE = "CASE WHEN listing_id % 7 = 0 THEN 'structured_source' WHEN listing_id % 5 = 0 THEN 'deterministic_rule' WHEN field = 'price' AND listing_id % 3 = 0 THEN 'price_conversion' WHEN category = 'geocode' THEN 'verified_geocode' WHEN listing_id % 4 = 1 THEN 'existing_manual' WHEN listing_id % 4 = 2 THEN 'inferred_only' ELSE 'legitimately_unknown' END"
_STATE = "CASE decision WHEN 'existing_manual' THEN 'already_resolved' WHEN 'inferred_only' THEN 'human_review_required' WHEN 'legitimately_unknown' THEN 'accepted_as_unknown' ELSE 'auto_resolved' END"


def _decided(spark, sf_dir):
    i = F.col("listing_id")
    d, s = Q.review_decision(i % 7 == 0, i % 5 == 0, (F.col("field") == "price") & (i % 3 == 0), F.col("category") == "geocode", F.lit(False), i % 4 == 1, i % 4 == 2)
    return _issues(spark, sf_dir).select("listing_id", "field", d.alias("decision"), s.alias("status"))


query("cls_review_decision", f"SELECT listing_id, field, decision, {_STATE} AS status FROM (SELECT *, {_DECIDE} AS decision FROM ({_ISSUES}))")(_decided)


@query("agg_review_run_summary", f"SELECT status, decision, count(*) AS n FROM (SELECT decision, {_STATE} AS status FROM (SELECT *, {_DECIDE} AS decision FROM ({_ISSUES}))) GROUP BY 1, 2")
def agg_review_run_summary(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("status", "decision").agg(F.count("*").alias("n"))


@query("cls_decision_state", f"WITH RECURSIVE {_STATES_SQL} SELECT * FROM states")
def cls_decision_state(spark, sf_dir):
    return _states(spark, sf_dir)


@query("cls_apply_decisions", "SELECT listing_id, CASE WHEN listing_id % 10 = 0 AND listing_id % 20 = 0 THEN 'villa' ELSE housing_type END AS housing_type, CASE WHEN listing_id % 10 = 0 AND listing_id % 20 = 0 THEN '9' ELSE CAST(bedrooms AS VARCHAR) END AS bedrooms, listing_id % 20 = 0 AS applied FROM listings")
def cls_apply_decisions(spark, sf_dir):
    rows = _listings(spark, sf_dir).withColumn("fingerprint", row_fingerprint(["listing_id", "housing_type", "bedrooms"]))
    fresh = rows.where("listing_id % 10 = 0").select("listing_id", F.when(F.col("listing_id") % 20 == 0, F.col("fingerprint")).otherwise("moved").alias("fingerprint"), F.explode(F.create_map(F.lit("housing_type"), F.lit("villa"), F.lit("bedrooms"), F.lit("9"))).alias("field", "value"))
    return Q.apply_updates(rows, fresh, "listing_id", ["housing_type", "bedrooms"]).select("listing_id", "housing_type", "bedrooms", "applied")


@query("cls_apply_manual_fixes", "SELECT listing_id, CASE WHEN listing_id % 97 = 0 THEN 'fixed' ELSE housing_type END AS housing_type, CASE WHEN listing_id % 97 = 0 THEN 'manual' END AS source FROM listings")
def cls_apply_manual_fixes(spark, sf_dir):
    rows = _listings(spark, sf_dir)
    patches = rows.where("listing_id % 97 = 0").select("listing_id", F.lit("fixed").alias("_p"))
    return rows.join(patches, "listing_id", "left").select("listing_id", F.coalesce("_p", "housing_type").alias("housing_type"), F.when(F.col("_p").isNotNull(), "manual").alias("source"))


@query("cls_run_completion", "SELECT run_id, bool_and(status = 'completed') AS complete, count(*) FILTER (before IS NOT NULL AND before <> input_rows) AS mismatches FROM (SELECT *, lag(output_rows) OVER (PARTITION BY run_id ORDER BY stage_no) AS before FROM stages) GROUP BY 1")
def cls_run_completion(spark, sf_dir):
    return Q.run_completion(frame(spark, sf_dir, "stages"), "run_id", "stage_no")


_BLOCK = _flags({"incomplete": "NOT complete", "row_counts": "mismatches > 3", "small": "n < 5"})
_RUNS = "SELECT run_id, bool_and(status = 'completed') AS complete, count(*) FILTER (before IS NOT NULL AND before <> input_rows) AS mismatches, count(*) AS n FROM (SELECT *, lag(output_rows) OVER (PARTITION BY run_id ORDER BY stage_no) AS before FROM stages) GROUP BY 1"


def _blocked(spark, sf_dir):
    rows = frame(spark, sf_dir, "stages")
    runs = Q.run_completion(rows, "run_id", "stage_no").join(rows.groupBy("run_id").agg(F.count("*").alias("n")), "run_id")
    return runs.withColumn("blockers", Q._present(F.when(~F.col("complete"), "incomplete"), F.when(F.col("mismatches") > 3, "row_counts"), F.when(F.col("n") < 5, "small")))


@query("cls_approval_blockers", f"SELECT run_id, {_BLOCK} AS blockers FROM ({_RUNS})")
def cls_approval_blockers(spark, sf_dir):
    return _blocked(spark, sf_dir).select("run_id", F.array_join("blockers", "|").alias("blockers"))


@query("cls_lifecycle_eligible", f"SELECT run_id, {_BLOCK} = '' AS eligible FROM ({_RUNS})")
def cls_lifecycle_eligible(spark, sf_dir):
    return _blocked(spark, sf_dir).select("run_id", (F.size("blockers") == 0).alias("eligible"))


#: Runs of customers by their first four orders: a stage each, with what came in and out; every 31st manifest is cut off.
FRAMES["run_stages"] = """
    SELECT o_custkey AS run, concat('stage', CAST(place - 1 AS STRING)) AS stage, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN 100 + CAST(floor(o_custkey / 7) AS BIGINT) END AS rows_in,
      100 + CAST(floor(o_custkey / 7) AS BIGINT) + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS rows_out
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) numbered WHERE place <= 4"""
_MANIFEST = """WITH c AS (SELECT DISTINCT run FROM run_stages), k AS (SELECT run, n, lag(n) OVER (PARTITION BY run ORDER BY n) AS before FROM (SELECT run, unnest(range(4)) AS n FROM c)),
  s AS (SELECT k.run, k.n, t.status, t.rows_in, p.rows_out AS given FROM k LEFT JOIN run_stages t ON t.run = k.run AND t.stage = 'stage' || k.n LEFT JOIN run_stages p ON p.run = k.run AND p.stage = 'stage' || k.before),
  g AS (SELECT run, count(status) AS stages, string_agg(CASE WHEN status IS NULL THEN 'missing_stage' || n WHEN status <> 'completed' THEN 'not_completed_stage' || n END, '|' ORDER BY n) AS a, string_agg(CASE WHEN given <> rows_in THEN 'rows_differ_stage' || n END, '|' ORDER BY n) AS b FROM s GROUP BY 1)
  SELECT run_id, stages, problems, count(*) AS n FROM (SELECT CASE WHEN run % 31 <> 0 THEN CASE WHEN run % 37 = 0 THEN '' ELSE 'run-' || run END END AS run_id, CASE WHEN run % 31 <> 0 THEN stages ELSE 0 END AS stages,
    CASE WHEN run % 31 = 0 THEN 'not_json' ELSE concat_ws('|', CASE WHEN run % 37 = 0 THEN 'no_run_id' END, CASE WHEN run % 41 = 0 THEN 'time_not_read' END, a, b, CASE WHEN run % 7 = 0 THEN 'errors' END, CASE WHEN run % 3 = 1 AND run % 4 <> 0 THEN 'not_approved' END, CASE WHEN run % 4 = 0 AND run % 5 <> 0 THEN 'warnings_not_acknowledged' END) END AS problems FROM g) GROUP BY ALL"""


@query("scan_run_manifest", _MANIFEST)
def scan_run_manifest(spark, sf_dir):
    """Manifests written as JSON documents, a line each, and read back with what is wrong with them."""
    run = F.col("run")
    stages = F.map_from_entries(F.collect_list(F.struct("stage", F.struct("status", F.col("rows_in").alias("input_rows"), F.col("rows_out").alias("output_rows")))))
    approval = F.struct(F.when(run % 4 == 0, "approved").otherwise("pending").alias("status"), F.when(run % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("acknowledged_warning_conditions"))
    manifest = F.struct(
        F.when(run % 37 == 0, "").otherwise(F.concat(F.lit("run-"), run.cast("string"))).alias("run_id"), F.when(run % 41 == 0, "soon").otherwise("2026-01-05T10:00:00Z").alias("created_at_utc"), (run % 3 == 1).alias("canonical_for_import"),
        F.array(F.lit("a")).alias("warnings"), F.when(run % 7 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("errors"), approval.alias("approval"), "stages",
    )
    text = frame(spark, sf_dir, "run_stages").groupBy("run").agg(stages.alias("stages")).select("run", F.to_json(manifest).alias("value"))
    path = scratch_path(spark, "manifests")
    text.select(F.when(run % 31 == 0, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value")).write.text(path)
    found = read_manifests(spark, path)
    return found.groupBy("run_id", F.coalesce(F.size("stages"), F.lit(0)).cast("long").alias("stages"), F.array_join("problems", "|").alias("problems")).agg(F.count("*").alias("n"))


@query("agg_metric_reconcile", "SELECT a.mode, a.n AS counted, b.n AS reported, coalesce(a.n, b.n) AS chosen, a.n IS DISTINCT FROM b.n AS differs FROM (SELECT l_shipmode AS mode, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1) a LEFT JOIN (SELECT l_returnflag AS mode, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' OR l_linenumber <> 7 GROUP BY 1) b ON a.mode = b.mode")
def agg_metric_reconcile(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "mode")
    a = items.groupBy("mode").agg(F.count("*").alias("counted"))
    b = items.where("mode <> 'N' or l_linenumber <> 7").groupBy("mode").agg(F.count("*").alias("reported"))
    return a.join(b, "mode", "left").select("mode", "counted", "reported", F.coalesce("counted", "reported").alias("chosen"), (~F.col("counted").eqNullSafe(F.col("reported"))).alias("differs"))


@query("agg_systemic_failure", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS total, max(n) AS top, coalesce(sum(n) FILTER (event_type = 'error'), 0) AS errors FROM c GROUP BY 1) SELECT user_id, CAST(total AS BIGINT) AS total, CAST(errors AS BIGINT) AS errors, total >= 10 AND errors >= 0.25 * total AS systemic FROM t")
def agg_systemic_failure(spark, sf_dir):
    errors = F.count_if(F.col("event_type") == "error")
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), errors.alias("errors"))
    return rows.withColumn("systemic", (F.col("total") >= 10) & (F.col("errors") >= 0.25 * F.col("total")))


@query("agg_audit_matrix", "SELECT field, count(*) AS audited, count(*) FILTER (verdict = 'matched') AS matched, count(*) FILTER (verdict = 'error') AS errors, count(*) FILTER (verdict = 'missing') AS missing FROM (SELECT 'price' AS field, CASE WHEN l.price_monthly IS NULL OR n.price_monthly IS NULL THEN 'missing' WHEN abs(l.price_monthly - n.price_monthly) <= 0.01 THEN 'matched' ELSE 'error' END AS verdict FROM listings l JOIN rebuilt n USING (listing_id) UNION ALL SELECT 'bedrooms', CASE WHEN l.bedrooms IS NULL OR n.bedrooms IS NULL THEN 'missing' WHEN l.bedrooms = n.bedrooms THEN 'matched' ELSE 'error' END FROM listings l JOIN rebuilt n USING (listing_id)) GROUP BY 1")
def agg_audit_matrix(spark, sf_dir):
    return _audit(spark, sf_dir).groupBy("field").agg(F.count("*").alias("audited"), F.count_if(F.col("verdict") == "matched").alias("matched"), F.count_if(F.col("verdict") == "error").alias("errors"), F.count_if(F.col("verdict") == "missing").alias("missing"))


def _audit(spark, sf_dir):
    new = frame(spark, sf_dir, "rebuilt").select("listing_id", F.col("price_monthly").alias("_p"), F.col("bedrooms").cast("double").alias("_b"))
    rows = _listings(spark, sf_dir).join(new, "listing_id")
    verdict = lambda a, b: F.when(a.isNull() | b.isNull(), "missing").when(F.abs(a - b) <= 0.01, "matched").otherwise("error")
    pairs = F.create_map(F.lit("price"), verdict(F.col("price_monthly"), F.col("_p")), F.lit("bedrooms"), verdict(F.col("bedrooms").cast("double"), F.col("_b")))
    return rows.select("listing_id", F.explode(pairs).alias("field", "verdict"))


@query("cls_listing_audit", "SELECT listing_id, 'price' AS field, CASE WHEN l.price_monthly IS NULL OR n.price_monthly IS NULL THEN 'missing' WHEN abs(l.price_monthly - n.price_monthly) <= 0.01 THEN 'matched' ELSE 'error' END AS verdict FROM listings l JOIN rebuilt n USING (listing_id)")
def cls_listing_audit(spark, sf_dir):
    return _audit(spark, sf_dir).where("field = 'price'")


_TAGS = {
    "housing:": "coalesce(housing_type, 'unknown')", "bedrooms:": "coalesce(CAST(bedrooms AS STRING), 'unknown')", "lease:": "coalesce(lease_type, 'unknown')", "gender:": "coalesce(preferred_gender, 'unspecified')",
    "furnished:": "coalesce(CAST(furnished AS STRING), 'unknown')", "utilities:": "coalesce(CAST(utilities_included AS STRING), 'unknown')", "sublet:": "CASE WHEN is_sublet THEN 'explicit' ELSE 'unstated' END",
    "price:": "CASE WHEN price_monthly <= low THEN 'low' WHEN price_monthly >= high THEN 'high' END", "availability:": "CASE WHEN availability_category = 'summer' THEN 'summer' END", "review:": "CASE WHEN data_quality_status = 'needs-review' THEN 'queue' END",
}
_COHORT = f"""WITH RECURSIVE l AS (SELECT *, quantile_cont(price_monthly, 0.1) OVER () AS low, quantile_cont(price_monthly, 0.9) OVER () AS high FROM listings),
  t AS MATERIALIZED (SELECT listing_id, list_sort(list_filter([{", ".join(f"'{n}' || {sql}" for n, sql in _TAGS.items())}], lambda x: x IS NOT NULL)) AS tags, sha256('cohort:' || CAST(listing_id AS VARCHAR)) AS h FROM l),
  o AS MATERIALIZED (SELECT tags, min(h) AS h FROM t GROUP BY 1),
  g(step, done, hs) AS (SELECT 0, []::VARCHAR[], []::VARCHAR[] UNION ALL
    SELECT step + 1, list_distinct(done || best.tags), hs || [best.h] FROM (SELECT step, done, hs, (SELECT {{'tags': o.tags, 'h': o.h, 'n': len(list_filter(o.tags, lambda x: NOT list_contains(done, x)))}} FROM o ORDER BY len(list_filter(o.tags, lambda x: NOT list_contains(done, x))) DESC, o.h LIMIT 1) AS best FROM g WHERE step < 40) WHERE best.n > 0),
  c AS (SELECT hs FROM g ORDER BY step DESC LIMIT 1),
  p AS (SELECT t.*, list_position((SELECT hs FROM c), h) AS place FROM t),
  q AS (SELECT *, coalesce(place, (SELECT len(hs) FROM c) + row_number() OVER (PARTITION BY place IS NULL ORDER BY h)) AS position FROM p)
  SELECT listing_id, CAST(position AS INT) AS position, CASE WHEN place IS NULL THEN 'fill' ELSE 'coverage' END AS reason, array_to_string(tags, '|') AS tags FROM q WHERE position <= 40"""


@query("cls_greedy_cohort", _COHORT)
def cls_greedy_cohort(spark, sf_dir):
    """40 listings for an audit: tags covered greedily, then a fill by hash."""
    rows = _listings(spark, sf_dir)
    cuts = rows.agg(F.percentile("price_monthly", 0.1).alias("low"), F.percentile("price_monthly", 0.9).alias("high"))
    tagged = rows.crossJoin(F.broadcast(cuts)).select("listing_id", F.array(*(F.concat(F.lit(n), F.expr(value)) for n, value in _TAGS.items())).alias("tags"))
    return cohorts.cover_and_fill(tagged, "listing_id", "tags", 40).withColumn("tags", F.array_join("tags", "|"))


_WANTED = ("price:low", "price:middle", "price:high", "gender", "explicit_sublet", "summer_non_sublet", "walking_surface", "utilities:all_included", "utilities:not_included", "ranking", "routing")
_SHORTLIST = f"""WITH RECURSIVE l AS (SELECT *, quantile_cont(price_monthly, 0.25) OVER () AS low, quantile_cont(price_monthly, 0.75) OVER () AS high FROM listings),
  t AS MATERIALIZED (SELECT listing_id, coalesce(ranking_overall_score, 0) AS score, sha256('demo:' || CAST(listing_id AS VARCHAR)) AS h, list_filter(['ranking', 'routing', CASE WHEN price_monthly <= low THEN 'price:low' WHEN price_monthly >= high THEN 'price:high' WHEN price_monthly IS NOT NULL THEN 'price:middle' END,
      CASE WHEN preferred_gender <> 'any' THEN 'gender' END, CASE WHEN is_sublet THEN 'explicit_sublet' END, CASE WHEN availability_category = 'summer' AND NOT coalesce(is_sublet, false) THEN 'summer_non_sublet' END, CASE WHEN location_map_visible THEN 'walking_surface' END,
      CASE WHEN utilities_included THEN 'utilities:all_included' WHEN NOT utilities_included THEN 'utilities:not_included' END], lambda x: x IS NOT NULL) AS tags FROM l WHERE ranking_status = 'ranked' AND location_route_available),
  g(step, done, ids, adds) AS (SELECT 0, []::VARCHAR[], []::BIGINT[], []::INT[] UNION ALL
    SELECT step + 1, list_distinct(done || best.tags), ids || [best.listing_id], adds || [best.n::INT] FROM (SELECT step, done, ids, adds, (SELECT {{'tags': t.tags, 'listing_id': t.listing_id, 'n': len(list_filter(t.tags, lambda x: NOT list_contains(done, x)))}} FROM t WHERE NOT list_contains(ids, t.listing_id)
      ORDER BY len(list_filter(t.tags, lambda x: NOT list_contains(done, x))) DESC, t.score DESC, t.h DESC LIMIT 1) AS best FROM g WHERE step < 12 AND NOT (len(done) = {len(_WANTED)} AND step >= 8)) WHERE best IS NOT NULL),
  e AS (SELECT ids, adds FROM g ORDER BY step DESC LIMIT 1)
  SELECT unnest(ids) AS listing_id, CAST(unnest(range(1, len(ids) + 1)) AS INT) AS position, unnest(adds) AS adds FROM e"""


@query("topk_diverse_shortlist", _SHORTLIST)
def topk_diverse_shortlist(spark, sf_dir):
    """Up to 12 ranked listings with a route that show all that is wanted."""
    rows = _listings(spark, sf_dir)
    cuts = rows.agg(F.percentile("price_monthly", 0.25).alias("low"), F.percentile("price_monthly", 0.75).alias("high"))
    price, sublet, included = F.col("price_monthly"), F.coalesce("is_sublet", F.lit(False)), F.col("utilities_included")
    tags = F.array(
        F.lit("ranking"), F.lit("routing"), F.when(price <= F.col("low"), "price:low").when(price >= F.col("high"), "price:high").when(price.isNotNull(), "price:middle"), F.when(F.col("preferred_gender") != "any", "gender"),
        F.when(sublet, "explicit_sublet"), F.when((F.col("availability_category") == "summer") & ~sublet, "summer_non_sublet"), F.when(F.col("location_map_visible"), "walking_surface"), F.when(included, "utilities:all_included").when(~included, "utilities:not_included"),
    )
    ready = rows.crossJoin(F.broadcast(cuts)).where("ranking_status = 'ranked' and location_route_available").withColumn("tags", tags)
    return cohorts.diverse_shortlist(ready, "listing_id", "tags", F.col("ranking_overall_score"), _WANTED)


@query("topk_review_queue", "SELECT listing_id, geocode_confidence FROM listings WHERE geocode_confidence < 0.1 ORDER BY geocode_confidence DESC, listing_id LIMIT 200")
def topk_review_queue(spark, sf_dir):
    return _listings(spark, sf_dir).where("geocode_confidence < 0.1").orderBy(F.desc("geocode_confidence"), "listing_id").limit(200).select("listing_id", "geocode_confidence")


@query("sort_natural_labels", "SELECT o_custkey, string_agg(label, ',' ORDER BY TRY_CAST(label AS INT) IS NULL, TRY_CAST(label AS INT), label) AS labels FROM (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_orderkey % 40 AS VARCHAR) END AS label FROM orders) GROUP BY 1")
def sort_natural_labels(spark, sf_dir):
    label = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise((F.col("o_orderkey") % 40).cast("string"))
    rows = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(label).alias("l"))
    return rows.select("o_custkey", F.array_join(O.natural_labels(F.col("l")), ",").alias("labels"))


@query("fn_fingerprint", """SELECT c_custkey, sha256(concat('{"c_custkey":', CAST(c_custkey AS VARCHAR), ',"c_mktsegment":', CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END, '}')) AS fingerprint FROM customer""")
def fn_fingerprint(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")))
    return rows.select("c_custkey", row_fingerprint(["c_mktsegment", "c_custkey"]).alias("fingerprint"))


@query("fn_review_flags", "SELECT listing_id, concat_ws('|', CASE WHEN price_monthly IS NULL THEN 'no_price' END, CASE WHEN is_sublet THEN 'sublet_evidence_blocked' END, CASE WHEN furnished THEN 'consensus_furnished' END) AS flags FROM listings")
def fn_review_flags(spark, sf_dir):
    rows = _listings(spark, sf_dir).withColumns({"sublet_evidence_blocked": F.col("is_sublet"), "consensus_furnished": F.col("furnished")})
    dynamic = [c for c in rows.columns if c.endswith("_evidence_blocked") or c.startswith("consensus_")]
    own = F.array(F.when(F.col("price_monthly").isNull(), "no_price"))
    flags = F.filter(F.array_union(own, F.array(*(F.when(F.col(c), F.lit(c)) for c in dynamic))), lambda x: x.isNotNull())
    return rows.select("listing_id", F.array_join(flags, "|").alias("flags"))


@query("fn_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AS even FROM events")
def fn_json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


#: What is known of a property's coordinates: customers joined to their nearest neighbour in number as the official point.
FRAMES["coordinate_evidence"] = """
    SELECT c_custkey AS property_id, c_custkey % 31 <> 0 AS current_usable, c_nationkey <> 3 AS dataset_current, c_nationkey <> 5 AS dataset_accepted, CASE WHEN c_custkey % 37 <> 0 THEN 1 - (c_custkey % 11) / 300e0 END AS match_confidence, c_custkey % 41 = 0 AS match_review,
      CASE WHEN c_custkey % 43 = 0 THEN 'two_candidates' END AS match_reason, CASE c_custkey % 13 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'exact' END AS unit_status, CASE WHEN c_custkey % 17 <> 0 THEN 1 + CAST(floor(c_custkey % 19 / 18) AS INT) END AS shared_properties,
      CASE c_custkey % 23 WHEN 0 THEN 'retired' WHEN 1 THEN NULL WHEN 2 THEN 'current' ELSE 'active' END AS address_status, CASE WHEN c_custkey % 29 <> 0 THEN 470000e0 + c_acctbal * 3 END AS city_x, 4750000e0 + c_custkey AS city_y, c_custkey % 47 <> 0 AS city_valid,
      CASE WHEN c_custkey % 53 = 0 THEN 4326 ELSE 26917 END AS city_srid, CASE c_custkey % 7 WHEN 0 THEN 'ambiguous' ELSE 'unique_contains' END AS parcel, CASE c_custkey % 5 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'missing' WHEN 2 THEN 'ambiguous' ELSE 'unique_contains' END AS building,
      c_custkey % 59 <> 0 AS provider_usable, CASE WHEN c_custkey % 61 <> 0 THEN abs(c_acctbal) / 100 END AS provider_distance, CASE WHEN c_custkey % 67 <> 0 THEN abs(c_acctbal) / 60 END AS movement, abs(c_acctbal) AS parcel_area, c_custkey % 4 AS parcel_buildings, c_custkey % 3 AS parcel_addresses
    FROM customer"""


@query("cls_coordinate_select", """SELECT property_id, concat_ws('|', CASE WHEN NOT current_usable THEN 'no_usable_current_coordinate' END, CASE WHEN NOT dataset_current THEN 'city_dataset_not_current' END, CASE WHEN NOT dataset_accepted THEN 'city_dataset_not_accepted' END,
    CASE WHEN match_confidence IS NULL OR match_confidence < 0.98 THEN 'city_match_confidence_below_threshold' END, CASE WHEN match_review THEN 'city_match_review_required' END, CASE WHEN match_reason IS NOT NULL THEN 'city_match_has_unresolved_reasons' END, CASE WHEN unit_status = 'unresolved' THEN 'unit_requires_exact_unit_match' END,
    CASE WHEN shared_properties IS DISTINCT FROM 1 THEN 'shared_municipal_address_point' END, CASE WHEN coalesce(address_status, '') NOT IN ('active', 'current') THEN 'municipal_address_status_not_accepted' END, CASE WHEN city_x IS NULL OR NOT city_valid OR city_srid <> 26917 THEN 'invalid_city_geometry'
      WHEN city_x > 495000 OR city_x < 469000 OR city_y > 4760000 THEN 'city_geometry_outside_london_bounds' END, CASE WHEN parcel <> 'unique_contains' THEN 'parcel_not_uniquely_resolved' END, CASE WHEN building IN ('ambiguous', 'contradiction') THEN 'building_not_uniquely_resolved' END,
    CASE WHEN NOT provider_usable OR provider_distance IS NULL THEN 'missing_usable_geoapify_comparison' END, CASE WHEN movement IS NULL THEN 'missing_city_movement_comparison' WHEN movement > 100 THEN 'automatic_city_movement_threshold_exceeded' END,
    CASE WHEN parcel_area > 6937.72 AND building <> 'unique_contains' THEN 'large_parcel_without_unique_building' END, CASE WHEN parcel_buildings > 1 AND building <> 'unique_contains' THEN 'multi_building_parcel_without_unique_building' END,
    CASE WHEN parcel_addresses > 1 AND building <> 'unique_contains' THEN 'multi_address_parcel_without_unique_building' END) AS blockers FROM coordinate_evidence""")
def cls_coordinate_select(spark, sf_dir):
    evidence = frame(spark, sf_dir, "coordinate_evidence").withColumn("match_reasons", F.array_compact(F.array("match_reason")))
    return evidence.select("property_id", F.array_join(Q.coordinate_gates((469000.0, 0.0, 495000.0, 4760000.0)), "|").alias("blockers"))


@query("agg_policy_gate_counts", "SELECT gate, count(*) AS n FROM (SELECT unnest(['a', 'b', 'c']) AS gate, listing_id, latitude, geocode_confidence FROM listings) WHERE (gate = 'a' AND latitude IS NULL) OR (gate = 'b' AND geocode_confidence < 0.3) OR (gate = 'c' AND listing_id % 50 = 0) GROUP BY 1")
def agg_policy_gate_counts(spark, sf_dir):
    gates = Q._present(F.when(F.col("latitude").isNull(), "a"), F.when(F.col("geocode_confidence") < 0.3, "b"), F.when(F.col("listing_id") % 50 == 0, "c"))
    return _listings(spark, sf_dir).select(F.explode(gates).alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))
