"""Histories and lifecycles, over events as observations and orders as listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import history as H
from ..operators import imports
from ..operators import lifecycle as L
from ..operators.sorts import top_per_key
from ..sources.scratch import scratch_path, stored
from ..sources.versions import OutOfOrderRun, VersionedTable
from .frames import frame, load
from .registry import query

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) AS k FROM observations) WHERE k = 1"


def _observations(spark, sf_dir):
    return frame(spark, sf_dir, "observations")


@query("win_latest_per_key", f"SELECT listing_id, id, observed_at, price_monthly, title FROM ({_LATEST})")
def win_latest_per_key(spark, sf_dir):
    return H.latest_per_key(_observations(spark, sf_dir), "listing_id", ["observed_at", "id"]).select("listing_id", "id", "observed_at", "price_monthly", "title")


@query("join_lateral_latest", f"SELECT c_custkey, c_mktsegment, o.id AS observation_id, o.price_monthly FROM customer LEFT JOIN ({_LATEST}) o ON o.listing_id = c_custkey")
def join_lateral_latest(spark, sf_dir):
    latest = H.latest_per_key(_observations(spark, sf_dir), "listing_id", ["observed_at", "id"]).select(F.col("listing_id").alias("c_custkey"), F.col("id").alias("observation_id"), "price_monthly")
    return load(spark, sf_dir, "customer").join(latest, "c_custkey", "left").select("c_custkey", "c_mktsegment", "observation_id", "price_monthly")


@query("win_freshest_current", """SELECT property_id, travel_mode, profile_id, is_stale FROM (SELECT *, row_number() OVER (PARTITION BY property_id, travel_mode, is_stale ORDER BY calculated_at DESC, profile_id DESC) AS k FROM profiles
  WHERE is_stale OR expires_at IS NULL OR expires_at > TIMESTAMP '1998-06-01 00:00:00') WHERE k = 1""")
def win_freshest_current(spark, sf_dir):
    alive = F.col("is_stale") | F.col("expires_at").isNull() | (F.col("expires_at") > F.lit("1998-06-01 00:00:00").cast("timestamp"))
    rows = frame(spark, sf_dir, "profiles").where(alive)
    return rows.groupBy("property_id", "travel_mode", "is_stale").agg(F.max_by("profile_id", F.struct("calculated_at", "profile_id")).alias("profile_id"))


_LAG = "SELECT *, lag(id) OVER w AS prev_id, lag(price_monthly) OVER w AS prev_price, lag(listing_status) OVER w AS prev_status, lag(trim(regexp_replace(lower(description), '\\s+', ' ', 'g'))) OVER w AS prev_text, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) AS text FROM observations WINDOW w AS (PARTITION BY listing_id ORDER BY observed_at, id)"


def _lagged(spark, sf_dir):
    rows = _observations(spark, sf_dir).withColumn("text", H.normalized(F.col("description")))
    return H.with_previous(rows, "listing_id", ["observed_at", "id"], ["id", "price_monthly", "listing_status", "text"])


@query("win_change_lag", f"SELECT id, listing_id, price_monthly - prev_price AS price_change, prev_id IS NOT NULL AND price_monthly IS DISTINCT FROM prev_price AS price_changed FROM ({_LAG})")
def win_change_lag(spark, sf_dir):
    changed = F.col("previous").isNotNull() & ~F.col("price_monthly").eqNullSafe(F.col("previous.price_monthly"))
    return _lagged(spark, sf_dir).select("id", "listing_id", (F.col("price_monthly") - F.col("previous.price_monthly")).alias("price_change"), changed.alias("price_changed"))


@query("fn_changed_fields", f"SELECT id, concat_ws('|', CASE WHEN prev_id IS NULL OR price_monthly IS DISTINCT FROM prev_price THEN 'price_monthly' END, CASE WHEN prev_id IS NULL OR listing_status IS DISTINCT FROM prev_status THEN 'listing_status' END, CASE WHEN prev_id IS NULL OR text IS DISTINCT FROM prev_text THEN 'text' END) AS changed FROM ({_LAG})")
def fn_changed_fields(spark, sf_dir):
    return _lagged(spark, sf_dir).select("id", F.array_join(H.changed_fields(["price_monthly", "listing_status", "text"]), "|").alias("changed"))


@query("cls_lifecycle_change", f"SELECT id, CASE WHEN prev_status IS NOT NULL AND listing_status = 'removed' AND prev_status <> 'removed' THEN 'removed' WHEN prev_status = 'removed' AND listing_status <> 'removed' THEN 'reactivated' END AS change FROM ({_LAG})")
def cls_lifecycle_change(spark, sf_dir):
    return _lagged(spark, sf_dir).select("id", H.lifecycle_change(F.col("listing_status"), F.col("previous.listing_status")).alias("change"))


_ORIGIN = "CASE WHEN prev_id IS NULL OR price_monthly IS NOT DISTINCT FROM prev_price THEN NULL WHEN text IS DISTINCT FROM prev_text AND regexp_matches(coalesce(text, ''), '\\$[0-9]+') THEN 'source_change' WHEN text IS NOT DISTINCT FROM prev_text THEN 'reinterpretation' ELSE 'unknown' END"


def _origin():
    changed = F.col("previous").isNotNull() & ~F.col("price_monthly").eqNullSafe(F.col("previous.price_monthly"))
    return H.change_origin(changed, ~F.col("text").eqNullSafe(F.col("previous.text")), F.coalesce("text", F.lit("")).rlike(r"\$[0-9]+"))


@query("cls_change_origin", f"SELECT id, {_ORIGIN} AS origin FROM ({_LAG})")
def cls_change_origin(spark, sf_dir):
    return _lagged(spark, sf_dir).select("id", _origin().alias("origin"))


@query("history_projection", f"SELECT listing_id, id, event_no, total > 5 AS has_more FROM (SELECT listing_id, id, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) AS event_no, count(*) OVER (PARTITION BY listing_id) AS total FROM (SELECT *, {_ORIGIN} AS origin FROM ({_LAG})) WHERE origin = 'source_change') WHERE event_no <= 5")
def history_projection(spark, sf_dir):
    rows = _lagged(spark, sf_dir).withColumn("origin", _origin()).where("origin = 'source_change'")
    return H.top_events(rows, "listing_id", [F.desc("observed_at"), F.desc("id")], 5).select("listing_id", "id", "event_no", "has_more")


@query("win_topn_events", "SELECT listing_id, id, event_no, total > 10 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) AS event_no, count(*) OVER (PARTITION BY listing_id) AS total FROM observations) WHERE event_no <= 10")
def win_topn_events(spark, sf_dir):
    return H.top_events(_observations(spark, sf_dir), "listing_id", [F.desc("observed_at"), F.desc("id")], 10).select("listing_id", "id", "event_no", "has_more")


@query("topk_history_desc", "SELECT listing_id, id FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, id DESC) AS k FROM observations) WHERE k <= 51")
def topk_history_desc(spark, sf_dir):
    return top_per_key(_observations(spark, sf_dir), ["listing_id"], [F.desc("observed_at"), F.desc("id")], 51).select("listing_id", "id")


@query("win_missing_runs", """WITH r AS (SELECT run_day, row_number() OVER (ORDER BY run_day) AS no FROM (SELECT DISTINCT run_day FROM observations)), s AS (SELECT listing_id, max(run_day) AS last_run FROM observations WHERE listing_status <> 'removed' GROUP BY 1)
  SELECT listing_id, last_run, e - no AS missed, CASE WHEN e - no = 0 THEN 'active' WHEN e - no < 2 THEN 'possibly_removed' ELSE 'removed' END AS status FROM s JOIN r ON run_day = last_run, (SELECT max(no) AS e FROM r)""")
def win_missing_runs(spark, sf_dir):
    rows = _observations(spark, sf_dir)
    return H.absence_runs(rows.where("listing_status <> 'removed'"), rows, "listing_id", "run_day")


@query("win_spread_sample", "WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part) SELECT p_partkey FROM n WHERE pos IN (SELECT CAST(round_even(i * (n - 1) / 24.0, 0) AS BIGINT) FROM range(25) r(i))")
def win_spread_sample(spark, sf_dir):
    return H.spread_sample(load(spark, sf_dir, "part"), "p_retailprice", "p_partkey", 25).select("p_partkey")


@query("win_grid_round_robin", """WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM places), c AS (SELECT place_id, CAST(least(4, floor((x - x0) * 5 / (x1 - x0))) * 5 + least(4, floor((y - y0) * 5 / (y1 - y0))) AS BIGINT) AS cell FROM places, b)
  SELECT place_id, cell, depth FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY place_id) AS depth FROM c) ORDER BY depth, cell, place_id LIMIT 120""")
def win_grid_round_robin(spark, sf_dir):
    return H.grid_round_robin(frame(spark, sf_dir, "places"), "x", "y", "place_id", 5, 120).select("place_id", "cell", "depth")


@query("win_stable_hash_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 20")
def win_stable_hash_sample(spark, sf_dir):
    return top_per_key(load(spark, sf_dir, "documents"), ["lang"], [H.stable_hash_order("audit", F.col("doc_id")), F.col("doc_id")], 20).select("doc_id", "lang")


@query("win_batch_assign", "SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4) AS BIGINT) AS batch FROM orders")
def win_batch_assign(spark, sf_dir):
    return H.batches(load(spark, sf_dir, "orders"), [F.col("o_orderkey")], 4, ["o_custkey"]).select("o_orderkey", "batch")


@query("win_supersede_chain", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS superseded_by, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS active FROM conversations WHERE role = 'user'")
def win_supersede_chain(spark, sf_dir):
    return H.supersede_chain(load(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id", ["turn"]).select("conv_id", "turn", "superseded_by", "active")


@query("win_repeat_page_stop", """WITH p AS (SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS page_no, list(DISTINCT o_custkey ORDER BY o_custkey) AS urls FROM orders GROUP BY 1), f AS (SELECT url, min(page_no) AS page_no FROM (SELECT page_no, unnest(urls) AS url FROM p) GROUP BY 1),
  n AS (SELECT p.page_no, p.urls, coalesce(c.n, 0) AS new_urls FROM p LEFT JOIN (SELECT page_no, count(*) AS n FROM f GROUP BY 1) c USING (page_no)), s AS (SELECT *, new_urls = 0 OR row_number() OVER (PARTITION BY urls ORDER BY page_no) > 1 AS stop FROM n)
  SELECT page_no, new_urls, CAST(sum(new_urls) OVER (ORDER BY page_no) AS BIGINT) AS seen FROM s WHERE page_no < coalesce((SELECT min(page_no) FROM s WHERE stop), 1000000000)""")
def win_repeat_page_stop(spark, sf_dir):
    pages = load(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 20).alias("page_no")).agg(F.collect_set("o_custkey").alias("urls"))
    return H.page_stop(pages, "page_no", "urls")


_SNAPSHOT = "SELECT o_orderkey AS id, md5(o_orderstatus || CAST(o_orderkey % 3 AS VARCHAR)) AS hash FROM orders WHERE o_orderkey % 10 <> 0"
_STATE = "SELECT o_orderkey AS id, md5(o_orderstatus || CAST(o_orderkey % 2 AS VARCHAR)) AS hash, CASE o_orderstatus WHEN 'F' THEN 'removed' WHEN 'P' THEN 'possibly_removed' ELSE 'active' END AS status, CAST(o_orderkey % 3 AS INT) AS missed FROM orders WHERE o_orderkey % 7 <> 0"


def _snapshot_state(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    mark = lambda m: F.md5(F.concat(F.col("o_orderstatus"), (key % m).cast("string")))
    snapshot = orders.where(key % 10 != 0).select(key.alias("id"), mark(3).alias("hash"))
    status = F.when(F.col("o_orderstatus") == "F", "removed").when(F.col("o_orderstatus") == "P", "possibly_removed").otherwise("active")
    return snapshot, orders.where(key % 7 != 0).select(key.alias("id"), mark(2).alias("hash"), status.alias("status"), (key % 3).cast("int").alias("missed"))


@query("classify_snapshot", f"SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'absent' WHEN o.status = 'removed' THEN 'relisted' WHEN n.hash = o.hash THEN 'unchanged' ELSE 'updated' END AS change FROM ({_SNAPSHOT}) n FULL JOIN ({_STATE}) o ON n.id = o.id")
def classify_snapshot(spark, sf_dir):
    return L.classify_snapshot(*_snapshot_state(spark, sf_dir), "id")


_NEXT = f"SELECT o.id, CASE WHEN n.id IS NOT NULL THEN 0 ELSE o.missed + 1 END AS missed, CASE WHEN n.id IS NOT NULL THEN 'active' WHEN o.status = 'removed' OR o.missed + 1 >= 2 THEN 'removed' ELSE 'possibly_removed' END AS status FROM ({_STATE}) o LEFT JOIN ({_SNAPSHOT}) n ON n.id = o.id"


@query("lifecycle_transition", _NEXT)
def lifecycle_transition(spark, sf_dir):
    snapshot, state = _snapshot_state(spark, sf_dir)
    return L.lifecycle_transition(state, snapshot, "id").select("id", "missed", "status")


@query("upsert_listing_state", f"SELECT coalesce(t.id, n.id) AS id, coalesce(t.status, 'active') AS status, coalesce(t.missed, 0) AS missed FROM ({_NEXT}) t FULL JOIN ({_SNAPSHOT}) n ON n.id = t.id")
def upsert_listing_state(spark, sf_dir):
    snapshot, state = _snapshot_state(spark, sf_dir)
    after = L.lifecycle_transition(state, snapshot, "id")
    return after.join(snapshot.select("id"), "id", "full").select("id", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("missed", F.lit(0)).alias("missed"))


def _run_sql(k: int) -> str:
    """The snapshot of the k-th run: some listings are missing, some changed, some are there twice."""
    rows = f"""SELECT listing_id, CASE WHEN listing_id % 11 = {k} THEN concat(address, ' Rear') ELSE address END AS match_key, price_monthly + CASE WHEN listing_id % {3 + k} = 0 THEN 10 ELSE 0 END AS price, title FROM listings WHERE listing_id % {7 + k} <> 0 AND NOT (listing_id % 5 = 1 AND {k} IN (2, 3))"""
    return f"{rows} UNION ALL SELECT listing_id, address, price_monthly, title FROM listings WHERE listing_id % 97 = {k}"


def _import_sql(runs: int) -> str:
    parts = ["s0 AS (SELECT * FROM (SELECT 0::BIGINT AS listing_id, '' AS property_key, '' AS property_match_key, '' AS match_key, 0e0 AS price, '' AS title, '' AS status, 0 AS missed) WHERE false)"]
    for k in range(1, runs + 1):
        parts.append(f"""r{k} AS ({_run_sql(k)}),
  x{k} AS (SELECT listing_id FROM r{k} GROUP BY 1 HAVING count(*) > 1), a{k} AS (SELECT * FROM r{k} WHERE listing_id NOT IN (SELECT listing_id FROM x{k})),
  m{k} AS (SELECT property_match_key AS match_key, min(property_key) AS known FROM s{k - 1} GROUP BY 1),
  j{k} AS (SELECT coalesce(n.listing_id, o.listing_id) AS listing_id, n.listing_id IS NOT NULL AS here, o.listing_id IS NOT NULL AS stored, x.listing_id IS NOT NULL AS unsafe, n.match_key, n.price, n.title, known, o.property_key AS link, o.property_match_key AS o_place,
      o.match_key AS o_match, o.price AS o_price, o.title AS o_title, o.status AS o_status, o.missed AS o_missed
    FROM a{k} n FULL JOIN s{k - 1} o ON o.listing_id = n.listing_id LEFT JOIN x{k} x ON x.listing_id = coalesce(n.listing_id, o.listing_id) LEFT JOIN m{k} m ON m.match_key = n.match_key),
  p{k} AS (SELECT *, CASE WHEN unsafe THEN 'kept' WHEN NOT stored THEN 'new' WHEN NOT here THEN 'absent' WHEN o_status = 'removed' THEN 'relisted' WHEN (match_key, price, title) IS DISTINCT FROM (o_match, o_price, o_title) THEN 'updated' ELSE 'unchanged' END AS change,
      CASE WHEN here THEN 'active' WHEN unsafe OR o_status = 'removed' THEN o_status WHEN o_missed >= 1 THEN 'removed' ELSE 'possibly_removed' END AS status FROM j{k}),
  s{k} AS (SELECT listing_id, coalesce(link, known, 'new-' || substr(sha256(match_key), 1, 16)) AS property_key, coalesce(o_place, match_key) AS property_match_key, CASE WHEN here THEN match_key ELSE o_match END AS match_key, CASE WHEN here THEN price ELSE o_price END AS price,
      CASE WHEN here THEN title ELSE o_title END AS title, status, CASE WHEN here THEN 0 WHEN unsafe THEN o_missed ELSE o_missed + 1 END AS missed FROM p{k}),
  c{k} AS (SELECT {k} AS run, count(*) FILTER (change = 'new') AS new_listings, count(*) FILTER (change = 'updated') AS updated_listings, count(*) FILTER (change = 'unchanged') AS unchanged_listings, count(*) FILTER (change = 'relisted') AS relisted_listings,
      count(*) FILTER (change = 'absent' AND status <> o_status AND status = 'possibly_removed') AS possibly_removed_listings, count(*) FILTER (change = 'absent' AND status <> o_status AND status = 'removed') AS removed_listings,
      count(*) FILTER (change IN ('new', 'updated', 'relisted') OR (change = 'absent' AND status <> o_status)) AS observations_inserted,
      count(DISTINCT CASE WHEN here AND link IS NULL AND known IS NULL THEN match_key END) AS properties_created, count(DISTINCT CASE WHEN here THEN coalesce(link, known) END) AS properties_reused, count(*) FILTER (here AND known <> link) AS possible_property_duplicates,
      count(*) FILTER (here AND price IS NULL) + count(*) FILTER (here AND stored AND match_key IS DISTINCT FROM o_match) + count(*) FILTER (here AND known <> link) AS review_items_created, (SELECT count(*) FROM r{k} WHERE listing_id IN (SELECT listing_id FROM x{k})) AS rows_rejected,
      count(*) FILTER (here AND (price IS NULL OR (stored AND match_key IS DISTINCT FROM o_match) OR known <> link)) AS rows_with_warnings FROM p{k})""")
    attempts = ", ".join(f"({a}, '{s}', {r})" for a, s, r in ((1, "promoted", 1), (2, "promoted", 2), (3, "already_imported", 2), (4, "promoted", 3), (5, "out_of_order", 0), (6, "promoted", 4), (7, "already_imported", 1)))
    every = " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(1, runs + 1))
    return f"WITH {', '.join(parts)}, u AS (UNPIVOT ({every}) ON COLUMNS(* EXCLUDE (run)) INTO NAME field VALUE n) SELECT attempt, status, field, n FROM (VALUES {attempts}) v(attempt, status, run) LEFT JOIN u USING (run)"


@query("import_plan", _import_sql(4))
def import_plan(spark, sf_dir):
    """Four runs into one state table, two of them again and one too late: each attempt's status and counts."""
    table = VersionedTable(spark, scratch_path(spark, "state"))
    listings = stored(frame(spark, sf_dir, "listings").select("listing_id", "address", "price_monthly", "title"))  # read by every run
    rows = []
    for attempt, (run, day) in enumerate(((1, 1), (2, 2), (2, 2), (3, 3), (4, 2), (4, 4), (1, 1)), 1):
        snapshot = spark.sql(_run_sql(run).replace("FROM listings", "FROM {listings}"), listings=listings)
        try:
            status, commit, _ = imports.import_run(table, snapshot, f"run-{run}", datetime(2024, 1, day))
            rows += [(attempt, status, name, n) for name, n in commit.summary.items()]
        except OutOfOrderRun:
            rows.append((attempt, "out_of_order", None, None))
    return spark.createDataFrame(rows, "attempt int, status string, field string, n long")


@query("join_anti_missing", f"SELECT id FROM ({_STATE}) WHERE id NOT IN (SELECT id FROM ({_SNAPSHOT}))")
def join_anti_missing(spark, sf_dir):
    snapshot, state = _snapshot_state(spark, sf_dir)
    return state.join(snapshot, "id", "left_anti").select("id")


@query("join_semi_discovered", f"SELECT id FROM ({_STATE}) WHERE id IN (SELECT id FROM ({_SNAPSHOT}))")
def join_semi_discovered(spark, sf_dir):
    snapshot, state = _snapshot_state(spark, sf_dir)
    return state.join(snapshot, "id", "left_semi").select("id")


@query("set_except_discovered", f"SELECT id FROM ({_SNAPSHOT}) EXCEPT SELECT id FROM ({_STATE})")
def set_except_discovered(spark, sf_dir):
    snapshot, state = _snapshot_state(spark, sf_dir)
    return snapshot.select("id").join(state, "id", "left_anti").distinct()


@query("set_equal_keys", f"SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM ({_SNAPSHOT}) n FULL JOIN ({_STATE}) o ON n.id = o.id WHERE n.id IS NULL OR o.id IS NULL")
def set_equal_keys(spark, sf_dir):
    return L.set_difference(*_snapshot_state(spark, sf_dir), "id")


@query("set_unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def set_unique_violations(spark, sf_dir):
    return L.duplicate_keys(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("set_union_layers", "SELECT layer, count(*) AS n FROM (SELECT 'stops' AS layer, x FROM stops UNION ALL SELECT 'places', x FROM places UNION ALL SELECT '__all__', x FROM stops UNION ALL SELECT '__all__', x FROM places) GROUP BY 1")
def set_union_layers(spark, sf_dir):
    layers = [frame(spark, sf_dir, n).select("x").withColumn("layer", F.array(F.lit(n), F.lit("__all__"))) for n in ("stops", "places")]
    return layers[0].unionByName(layers[1]).select(F.explode("layer").alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))


@query("set_intersect_routes", "WITH r AS (SELECT s.l_suppkey AS stop_id, count(DISTINCT s.l_partkey % 40) AS n FROM lineitem s WHERE s.l_partkey % 40 IN (SELECT DISTINCT l_partkey % 40 FROM lineitem WHERE l_suppkey = 3 AND l_linenumber = 1) GROUP BY 1) SELECT stop_id, n FROM r")
def set_intersect_routes(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").withColumn("route", F.col("l_partkey") % 40)
    goal = items.where("l_suppkey = 3 and l_linenumber = 1").agg(F.collect_set("route").alias("goal"))
    own = items.groupBy(F.col("l_suppkey").alias("stop_id")).agg(F.collect_set("route").alias("routes"))
    return own.crossJoin(F.broadcast(goal)).select("stop_id", F.size(F.array_intersect("routes", "goal")).cast("long").alias("n")).where("n > 0")


@query("set_dedupe_ordered", "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY first_at) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2) GROUP BY 1")
def set_dedupe_ordered(spark, sf_dir):
    first = load(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "o_orderpriority"))), lambda e: e.o_orderpriority)
    return first.groupBy("o_custkey").agg(F.array_join(ordered, "|").alias("priorities"))


@query("set_required_versions", "SELECT r.name, count(s.layer) AS current_versions FROM (VALUES ('0'), ('1'), ('2'), ('9')) r(name) LEFT JOIN (SELECT CAST(c_nationkey % 5 AS VARCHAR) AS layer FROM customer) s ON s.layer = r.name GROUP BY 1 HAVING count(s.layer) <> 1")
def set_required_versions(spark, sf_dir):
    required = spark.createDataFrame([("0",), ("1",), ("2",), ("9",)], "name string")
    current = load(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).cast("string").alias("name")).withColumn("one", F.lit(1))
    return required.join(current, "name", "left").groupBy("name").agg(F.count("one").alias("current_versions")).where("current_versions <> 1")


@query("sink_append_once", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE (user_id, CAST(ts AS DATE)) NOT IN (SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_id % 5 = 0)")
def sink_append_once(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id")
    return L.append_once(rows.drop("event_id"), rows.where("event_id % 5 = 0"), ["user_id", "day"])


_SCD_OLD = "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_custkey % 5 <> 0"
_SCD_NEW = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment, CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_custkey % 3 <> 0"


@query("scd2_merge", f"""WITH o AS ({_SCD_OLD}), n AS ({_SCD_NEW}), j AS (SELECT o.id AS oid, n.id AS nid, o.segment AS os, n.segment AS ns, o.nation AS o_n, n.nation AS n_n FROM o FULL JOIN n ON o.id = n.id)
  SELECT oid AS id, os AS segment, CASE WHEN nid IS NOT NULL AND (os IS DISTINCT FROM ns OR o_n IS DISTINCT FROM n_n) THEN 'closed' ELSE 'kept' END AS action FROM j WHERE oid IS NOT NULL
  UNION ALL SELECT nid, ns, 'inserted' FROM j WHERE nid IS NOT NULL AND (oid IS NULL OR os IS DISTINCT FROM ns OR o_n IS DISTINCT FROM n_n)""")
def scd2_merge(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))
    old = c.where("id % 5 <> 0").withColumn("valid_from", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    new = c.where("id % 3 <> 0").withColumn("segment", F.when(F.col("id") % 4 != 0, F.col("segment")))
    return L.scd2_merge(old, new, "id", ["segment", "nation"], F.lit("2024-02-01 00:00:00").cast("timestamp")).select("id", "segment", "action")


@query("upsert_keep_better", """WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'error' ELSE 'ok' END AS status, c_acctbal AS latitude, (c_custkey % 10) / 10e0 AS confidence FROM customer WHERE c_custkey % 4 <> 0),
  n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS latitude, (c_custkey % 7) / 10e0 AS confidence FROM customer WHERE c_custkey % 6 <> 0),
  j AS (SELECT coalesce(o.k, n.k) AS k, o.k AS ok, n.k AS nk, o.status AS os, n.status AS ns, o.confidence AS oc, n.confidence AS nc, o.k IS NULL OR (n.k IS NOT NULL AND (o.status <> 'ok' OR (n.status = 'ok' AND n.latitude IS NOT NULL AND n.confidence >= o.confidence))) AS better FROM o FULL JOIN n ON o.k = n.k)
  SELECT k, CASE WHEN better THEN ns ELSE os END AS status, CASE WHEN better THEN nc ELSE oc END AS confidence, CASE WHEN better THEN 'new' ELSE 'stored' END AS origin FROM j""")
def upsert_keep_better(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 4 != 0).select(k.alias("k"), F.when(k % 3 == 0, "error").otherwise("ok").alias("status"), F.col("c_acctbal").alias("latitude"), ((k % 10) / 10).alias("confidence"))
    new = c.where(k % 6 != 0).select(k.alias("k"), F.when(k % 5 == 0, "not_found").otherwise("ok").alias("status"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("latitude"), ((k % 7) / 10).alias("confidence"))
    return L.keep_better(old, new, ["k"]).select("k", "status", "confidence", "origin")


#: The listings, and those of some posted again under a new number, in other letters and spacing.
_REPOSTED = "SELECT listing_id, address, title, price_monthly, bedrooms FROM listings UNION ALL SELECT listing_id + 1000000000, upper(address), concat('  ', upper(title)), price_monthly, bedrooms FROM listings WHERE price_monthly > 4000 AND bedrooms < 4"


@query("agg_duplicate_ads", f"""WITH l AS (SELECT DISTINCT listing_id, lower(address) AS k, nullif(trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), '') AS d, price_monthly, bedrooms FROM ({_REPOSTED})),
  g AS (SELECT k, d, price_monthly, bedrooms, count(*) AS members, min(listing_id) AS "group" FROM l WHERE k IS NOT NULL AND d IS NOT NULL AND price_monthly IS NOT NULL AND bedrooms IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
  SELECT listing_id, "group", members FROM l JOIN g USING (k, d, price_monthly, bedrooms)""")
def agg_duplicate_ads(spark, sf_dir):
    posted = spark.sql(_REPOSTED.replace("FROM listings", "FROM {listings}"), listings=frame(spark, sf_dir, "listings"))
    rows = posted.withColumn("k", F.lower("address")).withColumn("d", X.comparison_text(F.col("title")))
    return L.duplicate_ads(rows, "listing_id", ["k", "d", "price_monthly", "bedrooms"])


_DAYS = "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS found FROM events WHERE event_type = 'error' GROUP BY 1"


@query("cls_discovery_health", f"WITH d AS ({_DAYS}), l AS (SELECT *, lag(found) OVER (ORDER BY day) AS before FROM d) SELECT day, found, concat_ws('|', CASE WHEN found < 45 THEN 'below_minimum' END, CASE WHEN found < before * 0.9 THEN 'substantial_drop' END) AS warnings FROM l")
def cls_discovery_health(spark, sf_dir):
    runs = load(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("found"))
    return L.discovery_health(runs, "day", "found", 45, 0.9).select("day", "found", F.array_join("warnings", "|").alias("warnings"))


@query("property_resolve", """WITH l AS (SELECT listing_id, address AS match_key FROM listings), s AS (SELECT listing_id, property_id FROM listings WHERE listing_id % 3 = 0), k AS (SELECT address AS match_key, min(property_id) AS property_id FROM listings WHERE property_id % 2 = 0 GROUP BY 1)
  SELECT l.listing_id, coalesce(CAST(s.property_id AS VARCHAR), CAST(k.property_id AS VARCHAR), 'new-' || substr(sha256(l.match_key), 1, 16)) AS property, CASE WHEN s.listing_id IS NOT NULL THEN 'link' WHEN k.match_key IS NOT NULL THEN 'match_key' ELSE 'created' END AS resolution
  FROM l LEFT JOIN s ON s.listing_id = l.listing_id LEFT JOIN k ON k.match_key = l.match_key""")
def property_resolve(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings").withColumn("match_key", F.col("address"))
    keys = rows.where("property_id % 2 = 0").groupBy("match_key").agg(F.min("property_id").alias("property_id"))
    return L.property_resolution(rows.select("listing_id", "match_key"), rows.where("listing_id % 3 = 0"), keys)
