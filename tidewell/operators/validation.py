"""Checks of geometry and sequences: each violation has a name, rows keep all of theirs, and reports count them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_POINTS = "array<struct<x: double, y: double>>"


def polygon_points(wkt: Column) -> Column:
    """The outer ring of `POLYGON((x y, ...))` as points; coordinates that can't be read are null, an empty or other text gives no points."""
    inside = F.regexp_extract(F.upper(wkt), r"^\s*POLYGON\s*\(\s*\(([^()]*)\)", 1)
    pairs = F.filter(F.split(inside, ","), lambda p: F.trim(p) != "")
    number = lambda p, i: F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double")
    return F.coalesce(F.transform(pairs, lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y"))), F.array().cast(_POINTS))


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)


def self_intersects(ring: Column) -> Column:
    """Whether two edges of a closed ring that aren't neighbours cross in their inside."""
    edges = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    numbered = F.transform(edges, lambda e, i: F.struct(e.a.alias("a"), e.b.alias("b"), i.alias("i")))
    apart = lambda e, f: (_cross(e.a, e.b, f.a) * _cross(e.a, e.b, f.b) < 0) & (_cross(f.a, f.b, e.a) * _cross(f.a, f.b, e.b) < 0)
    return F.exists(numbered, lambda e: F.exists(numbered, lambda f: (f.i > e.i + 1) & apart(e, f)))


def ring_violations(ring: Column, bounds: Sequence[float]) -> Column:
    """Names of what is wrong with a polygon's outer ring, in the order of the checks; a broken ring isn't checked further."""
    x0, y0, x1, y1 = map(F.lit, bounds)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = F.forall(ring, lambda p: finite(p.x) & finite(p.y))
    closed = (F.size(ring) > 0) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
    twice = F.aggregate(F.transform(ring, lambda p, i: F.struct(p.x.alias("x"), p.y.alias("y"), F.get(ring, i + 1).x.alias("u"), F.get(ring, i + 1).y.alias("v"))), F.lit(0.0), lambda s, e: s + F.coalesce(e.x * e.v - e.u * e.y, F.lit(0.0)))
    repeated = F.exists(F.transform(ring, lambda p, i: F.coalesce(p == F.get(ring, i + 1), F.lit(False))), lambda same: same)
    outside = F.exists(ring, lambda p: ~(p.x.between(x0, x1) & p.y.between(y0, y1)))
    some = F.size(ring) > 0
    return F.filter(
        F.array(
            F.when(~some, "empty_geometry"), F.when(~whole, "coordinate_not_finite"), F.when(some & (F.size(ring) < 4), "too_few_points"), F.when(some & ~closed, "ring_not_closed"), F.when(whole & repeated, "repeated_point"),
            F.when(whole & closed & (F.size(ring) >= 4) & (F.abs(twice) < 1e-9), "no_area"), F.when(whole & closed & self_intersects(ring), "self_intersection"), F.when(whole & outside, "out_of_bounds"),
        ),
        lambda v: v.isNotNull(),
    )


def snapshot_violations(features: DataFrame, key: str, wkt: str, srid: str, required: Sequence[str], *, expected_srid: int, bounds: Sequence[float]) -> DataFrame:
    """(key, violations) of every feature of a snapshot: key, reference system, kind, fields and ring.

    A repeated key is counted by an aggregation over keys, so no group of copies is brought together.
    """
    times = features.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1")
    rows = features.join(times, F.col(key) == F.col("_k"), "left")
    polygon = F.coalesce(F.upper(F.trim(wkt)).startswith("POLYGON"), F.lit(False))
    plain = F.filter(
        F.array(
            F.when(F.col(key).isNull(), "missing_id"), F.when(F.col("_n") > 1, "repeated_id"), F.when(~F.coalesce(F.col(srid) == expected_srid, F.lit(False)), "wrong_srid"), F.when(F.col(wkt).isNotNull() & ~polygon, "wrong_type"),
            *(F.when(F.col(c).isNull(), f"missing_{c}") for c in required),
        ),
        lambda v: v.isNotNull(),
    )
    ring = F.when(F.col(wkt).isNull() | polygon, polygon_points(F.col(wkt))).otherwise(F.lit(None).cast(_POINTS))
    rows = rows.select(key, plain.alias("_plain"), F.explode(F.array(ring)).alias("_ring"))  # the ring is parsed once, behind a generator
    return rows.select(key, F.concat("_plain", F.coalesce(F.when(F.col("_ring").isNotNull(), ring_violations(F.coalesce("_ring", F.array().cast(_POINTS)), bounds)), F.array().cast("array<string>"))).alias("violations"))


def counted(rows: DataFrame, violations: str = "violations") -> DataFrame:
    """(violation, n) with `__rows__` and `__valid__`, the rows in all and those without any."""
    named = F.concat(violations, F.array(F.lit("__rows__")), F.when(F.size(violations) == 0, F.array(F.lit("__valid__"))).otherwise(F.array().cast("array<string>")))
    return rows.select(F.explode(named).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def leg_violations(legs: DataFrame, route: str, order: Sequence[str], profiles: DataFrame) -> DataFrame:
    """(route, legs, violations, gap_seconds) of the legs (from_stop, to_stop, departs, arrives, from_offset, to_offset) of each route.

    - leg_break: a leg doesn't begin where the one before ended.
    - offset_falls: a leg's offset along its line falls between its stops.
    - arrives_before_departs within a leg, departs_before_arrival between legs.
    - duration_differs: first departure to last arrival isn't the profile's (route, duration); no_profile: there is none.
    """
    w = Window.partitionBy(route).orderBy(*order)
    rows = legs.withColumns({"_stop": F.lag("to_stop").over(w), "_arrived": F.lag("arrives").over(w)})
    sure = lambda test: F.coalesce(test, F.lit(False))
    found = rows.groupBy(route).agg(
        F.count("*").alias("legs"), F.bool_or(sure(F.col("_stop") != F.col("from_stop"))).alias("leg_break"), F.bool_or(sure(F.col("to_offset") <= F.col("from_offset"))).alias("offset_falls"), F.bool_or(sure(F.col("arrives") < F.col("departs"))).alias("arrives_before_departs"),
        F.bool_or(sure(F.col("departs") < F.col("_arrived"))).alias("departs_before_arrival"), (F.max("arrives") - F.min("departs")).alias("_took"),
    )
    both = found.join(profiles.select(route, F.col("duration").alias("_duration"), F.lit(True).alias("_has")), route, "left")
    checks = ("leg_break", "offset_falls", "arrives_before_departs", "departs_before_arrival")
    names = F.filter(F.array(*(F.when(F.col(c), c) for c in checks), F.when(F.col("_has") & ~sure(F.col("_took") == F.col("_duration")), "duration_differs"), F.when(F.col("_has").isNull(), "no_profile")), lambda v: v.isNotNull())
    return both.select(route, "legs", names.alias("violations"), (F.col("_took") - F.col("_duration")).alias("gap_seconds"))
