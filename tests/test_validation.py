"""Named violations of rings and legs, and crossings of random rings against plain arithmetic."""

import random

from pyspark.sql import functions as F

from tidewell.operators import validation

BOUNDS = (0.0, 0.0, 100.0, 100.0)


def found(spark, *rows):
    table = spark.createDataFrame(list(rows), "id long, wkt string, srid int, zoning string")
    out = validation.snapshot_violations(table, "id", "wkt", "srid", ["zoning"], expected_srid=26917, bounds=BOUNDS)
    return out, [r.violations for r in out.orderBy("id", "violations").collect()]


def one(spark, wkt):
    return found(spark, (1, wkt, 26917, "R1"))[1][0]


def test_rings(spark):
    assert one(spark, "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))") == one(spark, " polygon ( (0 0,10 0,10 10,0 0) ,(1 1,2 1,2 2,1 1)) ") == []
    assert one(spark, "POLYGON((0 0, 10 0, 10 10, 0 10))") == ["ring_not_closed"]
    assert one(spark, "POLYGON((0 0, 10 10, 10 0, 0 10, 0 0))") == ["no_area", "self_intersection"]
    assert one(spark, "POLYGON((0 0, 10 10, 10 0, 2 20, 0 0))") == ["self_intersection"]
    assert one(spark, "POLYGON((0 0, 10 0, 0 0))") == ["too_few_points"]
    assert one(spark, "POLYGON((0 0, 10 0, 10 0, 10 10, 0 0))") == ["repeated_point"]
    assert one(spark, "POLYGON((0 0, 10 0, 20 0, 0 0))") == ["no_area"]
    assert one(spark, "POLYGON((0 0, 101 0, 10 10, 0 0))") == ["out_of_bounds"]
    assert one(spark, "POLYGON((0 0, 10 x, 10 10, 0 0))") == one(spark, "POLYGON((0 0, NaN 1, 10 10, 0 0))") == ["coordinate_not_finite"]
    assert one(spark, "POLYGON EMPTY") == one(spark, None) == one(spark, "POLYGON(())") == ["empty_geometry"]
    assert one(spark, "POINT(1 1)") == ["wrong_type"]


def test_features(spark):
    square = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"
    out, named = found(spark, (None, square, 26917, "a"), (1, square, 26917, "a"), (2, square, 4326, None), (2, square, None, "b"))
    assert named == [["missing_id"], [], ["repeated_id", "wrong_srid"], ["repeated_id", "wrong_srid", "missing_zoning"]]
    assert {r.violation: r.n for r in validation.counted(out).collect()} == {"missing_id": 1, "repeated_id": 2, "wrong_srid": 2, "missing_zoning": 1, "__rows__": 4, "__valid__": 1}
    assert validation.counted(out.where("false")).collect() == []


def test_crossings_of_random_rings(spark):
    rng = random.Random(7)
    rings = []
    for _ in range(150):
        points = [(float(rng.randrange(8)), float(rng.randrange(8))) for _ in range(rng.randrange(3, 9))]
        rings.append([*points, points[0]])

    def cross(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def crosses(ring):
        edges = list(zip(ring, ring[1:], strict=False))
        return any(cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0 for i, (a, b) in enumerate(edges) for c, d in edges[i + 2 :])

    rows = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)], "id int, ring array<struct<x: double, y: double>>")
    got = {r.id: r.hit for r in rows.select("id", validation.self_intersects(F.col("ring")).alias("hit")).collect()}
    assert got == {i: crosses(r) for i, r in enumerate(rings)} and len(set(got.values())) == 2


def test_legs(spark):
    legs = spark.createDataFrame(
        [(1, 1, "a", "b", 0, 10, 0.0, 1.0), (1, 2, "b", "c", 10, 30, 1.0, 2.0), (2, 1, "a", "b", 0, 10, 0.0, 1.0), (2, 2, "x", "c", 5, 3, 2.0, 2.0), (3, 1, "a", "b", 0, 10, 0.0, 1.0), (4, 1, None, "b", None, 10, None, 1.0)],
        "route int, leg int, from_stop string, to_stop string, departs int, arrives int, from_offset double, to_offset double",
    )
    profiles = spark.createDataFrame([(1, 30), (2, 10), (3, 11)], "route int, duration int")
    got = {r.route: (r.legs, r.violations, r.gap_seconds) for r in validation.leg_violations(legs, "route", ["leg"], profiles).collect()}
    assert got == {1: (2, [], 0), 2: (2, ["leg_break", "offset_falls", "arrives_before_departs", "departs_before_arrival"], 0), 3: (1, ["duration_differs"], -1), 4: (1, ["no_profile"], None)}
