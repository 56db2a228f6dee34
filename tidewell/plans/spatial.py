"""Spatial queries, over suppliers as stops and customers as places on a plane of metres."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import spatial as S
from .frames import FRAMES, frame, load
from .registry import query

# lots are boxes of four corners, routes are runs of three points, facilities single segments
FRAMES["lots"] = "SELECT p_partkey AS lot_id, CAST(p_partkey * 3571 % 10007 AS DOUBLE) AS x0, CAST(p_partkey * 6133 % 10009 AS DOUBLE) AS y0, CAST(p_size * 8 AS DOUBLE) AS w, CAST(p_size * 5 + 20 AS DOUBLE) AS h FROM part"
FRAMES["route_points"] = "SELECT c_custkey AS route_id, v.k AS seq, CAST((c_custkey * 5231 + v.k * 37) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 8929 + v.k * v.k * 53) % 10009 AS DOUBLE) AS y FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) v(k)"
FRAMES["facilities"] = "SELECT p_partkey AS facility_id, CASE p_partkey % 3 WHEN 0 THEN 'lane' WHEN 1 THEN 'path' ELSE 'park' END AS category, CAST(p_partkey * 4099 % 10007 AS DOUBLE) AS x1, CAST(p_partkey * 7193 % 10009 AS DOUBLE) AS y1, CAST(p_partkey * 4099 % 10007 + p_size * 6 AS DOUBLE) AS x2, CAST(p_partkey * 7193 % 10009 + p_size * 4 AS DOUBLE) AS y2 FROM part"

_DIST = "sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y))"


def _lots(spark, sf_dir):
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    ring = F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return frame(spark, sf_dir, "lots").select("lot_id", ring.alias("ring"))


@query("fn_haversine", "SELECT listing_id, CASE WHEN latitude IS NOT NULL THEN round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(43.0096 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(43.0096)) * pow(sin(radians(-81.2737 - longitude) / 2), 2)))), 3) END AS metres FROM listings")
def fn_haversine(spark, sf_dir):
    return frame(spark, sf_dir, "listings").select("listing_id", F.round(G.haversine(F.col("latitude"), F.col("longitude"), F.lit(43.0096), F.lit(-81.2737)), 3).alias("metres"))


_N = "(1 / 298.257223563) / (2 - 1 / 298.257223563)"


def _utm_sql() -> tuple[str, str]:
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    t = f"WITH t AS (SELECT listing_id, sinh(atanh(sin(radians(latitude))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(latitude)))) AS t, radians(longitude + 81.0) AS lam FROM listings), c AS (SELECT listing_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)"
    east = " + ".join(["eta", *(f"{v!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(a, 1))])
    north = " + ".join(["xi", *(f"{v!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(a, 1))])
    return t, f"round(500000 + {scale!r}::DOUBLE * ({east}), 2) AS easting, round({scale!r}::DOUBLE * ({north}), 2) AS northing"


@query("fn_utm17", f"{_utm_sql()[0]} SELECT listing_id, {_utm_sql()[1]} FROM c")
def fn_utm17(spark, sf_dir):
    east, north = G.to_utm17(F.col("latitude"), F.col("longitude"))
    return frame(spark, sf_dir, "listings").select("listing_id", F.round(east, 2).alias("easting"), F.round(north, 2).alias("northing"))


@query("fn_grid_cell", "SELECT place_id, CASE WHEN x < 10000 AND y < 8000 THEN CAST(floor(y / 200) * 50 + floor(x / 200) AS BIGINT) END AS cell FROM places")
def fn_grid_cell(spark, sf_dir):
    return frame(spark, sf_dir, "places").select("place_id", G.grid_cell(F.col("x"), F.col("y"), 0.0, 0.0, 200.0, 50, 40).alias("cell"))


@query("join_radius", f"SELECT place_id, stop_id, round({_DIST}, 4) AS distance FROM places p, stops s WHERE {_DIST} <= 600")
def join_radius(spark, sf_dir):
    return S.join_radius(frame(spark, sf_dir, "places"), frame(spark, sf_dir, "stops"), 600.0, parts=4).select("place_id", F.col("r_stop_id").alias("stop_id"), F.round("distance", 4).alias("distance"))


@query("join_nearest", f"SELECT place_id, nearest, round(distance, 4) AS distance FROM (SELECT place_id, stop_id AS nearest, {_DIST} AS distance, row_number() OVER (PARTITION BY place_id ORDER BY {_DIST}, stop_id) AS k FROM places p, stops s) WHERE k = 1")
def join_nearest(spark, sf_dir):
    found = S.join_nearest(frame(spark, sf_dir, "places"), frame(spark, sf_dir, "stops"), "place_id", "stop_id", 400.0, 12800.0)
    return found.select("place_id", "nearest", F.round("distance", 4).alias("distance"))


@query("join_exact_origin", f"SELECT place_id, stop_id FROM places p, stops s WHERE {_DIST} <= 120")
def join_exact_origin(spark, sf_dir):
    return S.join_radius(frame(spark, sf_dir, "places"), frame(spark, sf_dir, "stops"), 120.0).select("place_id", F.col("r_stop_id").alias("stop_id"))


_IN = "x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h"


@query("join_point_in_polygon", f"WITH c AS (SELECT place_id, count(lot_id) AS n, min(lot_id) AS one FROM places LEFT JOIN lots ON {_IN} GROUP BY 1) SELECT place_id, CASE WHEN n = 1 THEN one END AS match, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS method FROM c")
def join_point_in_polygon(spark, sf_dir):
    return S.match_one(S.count_rings(frame(spark, sf_dir, "places"), _lots(spark, sf_dir), "place_id", "lot_id", 125.0), "place_id")


@query("join_polygon_intersects", f"SELECT lot_id, count(place_id) AS n_places, round(any_value(w * h), 4) AS area FROM lots JOIN places ON {_IN} GROUP BY 1")
def join_polygon_intersects(spark, sf_dir):
    lots = _lots(spark, sf_dir)
    counts = S.count_points(frame(spark, sf_dir, "places"), lots, "lot_id", 125.0).withColumnRenamed("n", "n_places")
    return lots.withColumn("area", F.round(G.ring_area(F.col("ring")), 4)).join(counts, "lot_id").select("lot_id", "n_places", "area")


@query("polygon_area_length", "SELECT lot_id, round(w * h, 4) AS area, round(2 * (w + h), 4) AS length FROM lots")
def polygon_area_length(spark, sf_dir):
    return _lots(spark, sf_dir).select("lot_id", F.round(G.ring_area(F.col("ring")), 4).alias("area"), F.round(G.line_length(F.col("ring")), 4).alias("length"))


_SEG = "SELECT route_id, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2, row_number() OVER w - 1 AS step FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)"


def _segments(spark, sf_dir):
    return S.segments(frame(spark, sf_dir, "route_points"), "route_id", ["seq"])


@query("win_segment_lengths", f"SELECT route_id, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 4) AS length, round(max(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 4) AS jump FROM ({_SEG}) WHERE x1 IS NOT NULL GROUP BY 1")
def win_segment_lengths(spark, sf_dir):
    step = G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return _segments(spark, sf_dir).groupBy("route_id").agg(F.round(F.sum(step), 4).alias("length"), F.round(F.max(step), 4).alias("jump"))


@query("route_length_validate", f"SELECT route_id, CASE WHEN jump > 5000 THEN 'jump' ELSE 'ok' END AS verdict FROM (SELECT route_id, max(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS jump FROM ({_SEG}) WHERE x1 IS NOT NULL GROUP BY 1)")
def route_length_validate(spark, sf_dir):
    jump = F.max(G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return _segments(spark, sf_dir).groupBy("route_id").agg(jump.alias("jump")).select("route_id", F.when(F.col("jump") > 5000, "jump").otherwise("ok").alias("verdict"))


def _segment_distance(px: str, py: str, s: str = "s") -> str:
    d, q = f"(({s}.x2 - {s}.x1) * ({s}.x2 - {s}.x1) + ({s}.y2 - {s}.y1) * ({s}.y2 - {s}.y1))", f"(({px} - {s}.x1) * ({s}.x2 - {s}.x1) + ({py} - {s}.y1) * ({s}.y2 - {s}.y1))"
    t = f"(CASE WHEN {d} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, {q} / {d})) END)"
    return f"sqrt(pow({px} - {s}.x1 - {t} * ({s}.x2 - {s}.x1), 2) + pow({py} - {s}.y1 - {t} * ({s}.y2 - {s}.y1), 2))"


@query("join_within_distance", f"SELECT place_id, facility_id, round(d, 3) AS distance FROM (SELECT place_id, facility_id, {_segment_distance('p.x', 'p.y')} AS d FROM places p, facilities s) WHERE d <= 150")
def join_within_distance(spark, sf_dir):
    return S.join_near_segments(frame(spark, sf_dir, "places"), frame(spark, sf_dir, "facilities"), 150.0).select("place_id", "facility_id", F.round("distance", 3).alias("distance"))


@query("nearest_facility", f"SELECT place_id, category, round(min(d), 3) AS distance FROM (SELECT place_id, category, {_segment_distance('p.x', 'p.y')} AS d FROM places p, facilities s) WHERE d <= 400 GROUP BY 1, 2")
def nearest_facility(spark, sf_dir):
    near = S.nearest_segments(frame(spark, sf_dir, "places"), frame(spark, sf_dir, "facilities"), "place_id", "category", 400.0)
    return near.select("place_id", "category", F.round("distance", 3).alias("distance"))


# the range of t that a segment's line spends in the rectangle and in the discs around a facility
_RANGES = f"""r AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM ({_SEG}) WHERE x1 IS NOT NULL),
 p AS (SELECT r.route_id, r.step, r.len, f.category, t AS tol, r.x2 - r.x1 AS dx, r.y2 - r.y1 AS dy, r.x1 - f.x1 AS px, r.y1 - f.y1 AS py, r.x1 - f.x2 AS qx, r.y1 - f.y2 AS qy, f.x2 - f.x1 AS fx, f.y2 - f.y1 AS fy
   FROM r JOIN facilities f ON least(f.x1, f.x2) <= greatest(r.x1, r.x2) + 15 AND greatest(f.x1, f.x2) >= least(r.x1, r.x2) - 15 AND least(f.y1, f.y2) <= greatest(r.y1, r.y2) + 15 AND greatest(f.y1, f.y2) >= least(r.y1, r.y2) - 15, (VALUES (5e0), (8e0), (10e0), (15e0)) v(t) WHERE r.len > 0),
 q AS (SELECT *, sqrt(fx * fx + fy * fy) AS fl, (px * dx + py * dy) * (px * dx + py * dy) - len * len * (px * px + py * py - tol * tol) AS d1, (qx * dx + qy * dy) * (qx * dx + qy * dy) - len * len * (qx * qx + qy * qy - tol * tol) AS d2 FROM p),
 s AS (SELECT *, (px * fx + py * fy) / fl AS al, (dx * fx + dy * fy) / fl AS be, (px * fy - py * fx) / fl AS ga, (dx * fy - dy * fx) / fl AS de FROM q),
 b AS (SELECT *, CASE WHEN be = 0 THEN CASE WHEN al BETWEEN 0 AND fl THEN -1e18 ELSE 1e18 END ELSE least(-al / be, (fl - al) / be) END AS a1, CASE WHEN be = 0 THEN CASE WHEN al BETWEEN 0 AND fl THEN 1e18 ELSE -1e18 END ELSE greatest(-al / be, (fl - al) / be) END AS a2,
   CASE WHEN de = 0 THEN CASE WHEN ga BETWEEN -tol AND tol THEN -1e18 ELSE 1e18 END ELSE least((-tol - ga) / de, (tol - ga) / de) END AS c1, CASE WHEN de = 0 THEN CASE WHEN ga BETWEEN -tol AND tol THEN 1e18 ELSE -1e18 END ELSE greatest((-tol - ga) / de, (tol - ga) / de) END AS c2 FROM s),
 u AS (SELECT route_id, step, len, category, tol, greatest(a1, c1) <= least(a2, c2) OR d1 >= 0 OR d2 >= 0 AS hit, greatest(0, least(CASE WHEN greatest(a1, c1) <= least(a2, c2) THEN greatest(a1, c1) END, CASE WHEN d1 >= 0 THEN (-(px * dx + py * dy) - sqrt(d1)) / (len * len) END, CASE WHEN d2 >= 0 THEN (-(qx * dx + qy * dy) - sqrt(d2)) / (len * len) END)) AS low,
   least(1, greatest(CASE WHEN greatest(a1, c1) <= least(a2, c2) THEN least(a2, c2) END, CASE WHEN d1 >= 0 THEN (-(px * dx + py * dy) + sqrt(d1)) / (len * len) END, CASE WHEN d2 >= 0 THEN (-(qx * dx + qy * dy) + sqrt(d2)) / (len * len) END)) AS high FROM b),
 w AS (SELECT route_id, step, len, tol, low, high, unnest([category, NULL]) AS category FROM u WHERE hit AND low < high),
 f AS (SELECT *, greatest(0, high - greatest(low, coalesce(max(high) OVER (PARTITION BY route_id, step, tol, category ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) * len AS part FROM w),
 o AS (SELECT route_id, tol, category, sum(part) AS overlap FROM f GROUP BY ALL), l AS (SELECT route_id, sum(len) AS length FROM r GROUP BY 1)"""


@query("route_overlap_share", f"""WITH {_RANGES} SELECT route_id, tol AS tolerance, coalesce(category, 'all') AS category, round(length, 3) AS length, round(overlap, 3) AS overlap FROM o JOIN l USING (route_id)
  UNION ALL SELECT route_id, t, 'all', round(length, 3), 0 FROM l, (VALUES (5e0), (8e0), (10e0), (15e0)) v(t) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.route_id = l.route_id AND o.tol = t)""")
def route_overlap_share(spark, sf_dir):
    shares = S.overlap_share(_segments(spark, sf_dir), frame(spark, sf_dir, "facilities"), "route_id", (5, 8, 10, 15))
    return shares.select("route_id", "tolerance", F.coalesce("category", F.lit("all")).alias("category"), F.round("length", 3).alias("length"), F.round("overlap", 3).alias("overlap"))


@query("join_cross_tolerances", "SELECT category, t AS tolerance, count(*) AS n FROM facilities, (VALUES (5), (8), (10), (15)) v(t) GROUP BY 1, 2")
def join_cross_tolerances(spark, sf_dir):
    each = F.explode(F.array(*(F.lit(t) for t in (5, 8, 10, 15))))
    return frame(spark, sf_dir, "facilities").select("category", each.alias("tolerance")).groupBy("category", "tolerance").agg(F.count("*").alias("n"))


@query("agg_facility_totals", "SELECT category, count(*) AS n, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 2) AS length FROM facilities GROUP BY 1")
def agg_facility_totals(spark, sf_dir):
    return frame(spark, sf_dir, "facilities").groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum(G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))), 2).alias("length"))


_ROUTES = "SELECT DISTINCT l_suppkey AS stop_id, l_partkey % 40 AS route FROM lineitem"


def _stop_routes(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stop_id"), (F.col("l_partkey") % 40).alias("route")).distinct()


@query("join_stop_routes", "SELECT l_suppkey AS stop_id, o_custkey % 60 AS route, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def join_stop_routes(spark, sf_dir):
    joined = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("l_suppkey").alias("stop_id"), (F.col("o_custkey") % 60).alias("route")).agg(F.count("*").alias("n"))


_GOAL = f"SELECT DISTINCT route FROM ({_ROUTES}) JOIN stops s USING (stop_id) WHERE sqrt((s.x - 5000) * (s.x - 5000) + (s.y - 5000) * (s.y - 5000)) <= 900"


def _goal_routes(spark, sf_dir):
    near = frame(spark, sf_dir, "stops").where(G.distance(F.col("x"), F.col("y"), F.lit(5000.0), F.lit(5000.0)) <= 900)
    return _stop_routes(spark, sf_dir).join(near, "stop_id").select("route").distinct()


query("transit_destination_routes", _GOAL)(_goal_routes)


@query("transit_stop_score", f"""WITH d AS (SELECT place_id, stop_id, {_DIST} AS distance FROM places p, stops s), n AS (SELECT place_id, min(distance) AS nearest FROM d GROUP BY 1),
  r AS (SELECT place_id, count(DISTINCT route) AS routes, count(DISTINCT route) FILTER (route IN ({_GOAL})) AS shared FROM d JOIN ({_ROUTES}) USING (stop_id) WHERE distance <= 600 GROUP BY 1)
  SELECT place_id, coalesce(routes, 0) AS routes, coalesce(shared, 0) AS shared, CAST(round_even(greatest(0.0, least(45.0, 45 * (1 - greatest(0.0, nearest - 150) / 750))) + least(25, coalesce(routes, 0) * 5) + least(30, coalesce(shared, 0) * 15), 0) AS INT) AS score FROM n LEFT JOIN r USING (place_id)""")
def transit_stop_score(spark, sf_dir):
    places, stops = frame(spark, sf_dir, "places"), frame(spark, sf_dir, "stops")
    nearest = S.join_nearest(places, stops, "place_id", "stop_id", 400.0, 12800.0)
    sites = stops.join(_stop_routes(spark, sf_dir), "stop_id").join(_goal_routes(spark, sf_dir).withColumn("goal", F.lit(True)), "route", "left")
    routes = S.count_reached(places, sites, "place_id", "route", "goal", 600.0).select("place_id", F.col("n").alias("routes"), F.col("n_chosen").alias("shared"))
    rows = nearest.join(routes, "place_id", "left").select("place_id", "distance", F.coalesce("routes", F.lit(0)).alias("routes"), F.coalesce("shared", F.lit(0)).alias("shared"))
    return rows.select("place_id", "routes", "shared", S.transit_stop_score(F.col("distance"), F.col("routes"), F.col("shared")).alias("score"))


@query("straight_line_estimate", "SELECT place_id, mode, round(d * 1.35, 3) AS metres, CAST(ceil(d * 1.35 / (kmh * 1000 / 3600)) AS BIGINT) AS seconds FROM (SELECT place_id, sqrt((x - 5000) * (x - 5000) + (y - 5000) * (y - 5000)) AS d FROM places), (VALUES ('walking', 4.8), ('cycling', 15.0)) v(mode, kmh)")
def straight_line_estimate(spark, sf_dir):
    speeds = F.explode(F.create_map(F.lit("walking"), F.lit(4.8), F.lit("cycling"), F.lit(15.0)))
    rows = frame(spark, sf_dir, "places").select("place_id", G.distance(F.col("x"), F.col("y"), F.lit(5000.0), F.lit(5000.0)).alias("d"), speeds.alias("mode", "kmh"))
    return rows.select("place_id", "mode", F.round(F.col("d") * 1.35, 3).alias("metres"), F.ceil(F.col("d") * 1.35 / (F.col("kmh") * 1000 / 3600)).alias("seconds"))


_CELL = "CAST(floor(y / 500) * 21 + floor(x / 500) AS BIGINT)"


@query("join_surface_grid", f"SELECT g.c AS cell, p.seconds FROM range(441) g(c) LEFT JOIN (SELECT {_CELL} AS cell, min(CAST(place_id % 7200 AS INT)) AS seconds FROM places GROUP BY 1) p ON p.cell = g.c")
def join_surface_grid(spark, sf_dir):
    return _surface(spark, sf_dir)


def _surface(spark, sf_dir):
    rows = frame(spark, sf_dir, "places").withColumn("cell", G.grid_cell(F.col("x"), F.col("y"), 0.0, 0.0, 500.0, 21, 21)).groupBy("cell").agg(F.min((F.col("place_id") % 7200).cast("int")).alias("seconds"))
    return spark.range(441).withColumnRenamed("id", "cell").join(rows, "cell", "left")


_PACKED = f"SELECT array_to_string(list(coalesce(seconds, 65535) ORDER BY cell), ',') AS cells, count(seconds) AS available, count(*) AS n FROM (SELECT g.c AS cell, p.seconds FROM range(441) g(c) LEFT JOIN (SELECT {_CELL} AS cell, min(CAST(place_id % 7200 AS INT)) AS seconds FROM places GROUP BY 1) p ON p.cell = g.c)"


@query("surface_pack", _PACKED)
def surface_pack(spark, sf_dir):
    return _packed(spark, sf_dir).select(F.array_join("cells", ",").alias("cells"), "available", "n")


def _packed(spark, sf_dir):
    """One row with a vector of a fixed grid: 441 cells whatever the input."""
    entry = F.struct("cell", F.coalesce("seconds", F.lit(65535)).alias("s"))
    return _surface(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.s).alias("cells"), F.count("seconds").alias("available"), F.count("*").alias("n"))


@query("surface_unpack", f"SELECT CAST(g.c AS INT) AS cell, p.seconds FROM range(441) g(c) LEFT JOIN (SELECT {_CELL} AS cell, min(CAST(place_id % 7200 AS INT)) AS seconds FROM places GROUP BY 1) p ON p.cell = g.c")
def surface_unpack(spark, sf_dir):
    return _packed(spark, sf_dir).select(F.posexplode("cells").alias("cell", "s")).select("cell", F.nullif("s", F.lit(65535)).alias("seconds"))


@query("surface_snap_coverage", f"SELECT t AS threshold, count(*) FILTER (d <= t) AS covered, count(*) AS n, round(median(d), 3) AS median_snap, round(quantile_cont(d, 0.9), 3) AS p90_snap FROM (SELECT place_id, min({_DIST}) AS d FROM places p, stops s GROUP BY 1), (VALUES (100), (200), (400), (600)) v(t) GROUP BY 1")
def surface_snap_coverage(spark, sf_dir):
    nearest = S.join_nearest(frame(spark, sf_dir, "places"), frame(spark, sf_dir, "stops"), "place_id", "stop_id", 400.0, 12800.0)
    return S.snap_coverage(nearest, (100, 200, 400, 600))
