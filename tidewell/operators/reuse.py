"""Reuse of stored travel profiles for new requests: a ladder of tiers from exact to estimated."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G

# Metres within which a profile is of the same property, of the same origin, or near.
PROPERTY_METRES, ORIGIN_METRES, NEAR_METRES = 20.0, 3.0, 125.0
# How much longer a connector is than its straight line, and km/h by mode.
DETOUR, KMH = 1.35, {"walking": 4.8, "cycling": 15.0}
# Confidence of a profile that states none, and factors of the estimates.
UNSTATED, SAME_STOP, NEARBY, NEARBY_FALL, STRAIGHT = 0.7, 0.9, 0.85, 0.25, 0.65

TIERS = ("cached_exact_property", "cached_exact_origin", "same_stop_reuse", "nearby_origin_estimate", "stale", "straight_line_estimate", "pending_provider", "unavailable")
# What a point offers, the best last.
_STALE, _NEAR, _EXACT = 1, 2, 3

_FIELDS = ("profile_id", "duration", "shortest", "longest", "distance", "walking", "confidence", "to_destination", "origin_walk")


def _unit_cells(lat: Column, lon: Column, size: float) -> list[Column]:
    """The cell of a point on the sphere, in three dimensions: points within `size` metres are in adjacent cells, at the poles too."""
    phi, lam = F.radians(lat), F.radians(lon)
    at = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [F.floor(v * (G.EARTH_RADIUS / size)).alias(n) for v, n in zip(at, ("_x", "_y", "_z"), strict=True)]


def near_points(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(latitude, longitude, near_latitude, near_longitude, metres): distinct points of left with those of right within the distance.

    Points are distinct first, so a building with many units is compared once;
    the pairs meet by grid cell, each point of left in its 27 cells.
    """
    point = ["latitude", "longitude"]
    distinct = lambda rows: rows.where("latitude is not null and longitude is not null").select(*point).distinct()
    around = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip((x, y, z), "xyz", strict=True))) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)))
    own = distinct(left).select("*", *_unit_cells(F.col("latitude"), F.col("longitude"), metres)).withColumn("_d", F.explode(around))
    own = own.select(*point, *((F.col(f"_{a}") + F.col(f"_d.{a}")).alias(f"_{a}") for a in "xyz"))
    other = distinct(right).select(F.col("latitude").alias("near_latitude"), F.col("longitude").alias("near_longitude"), *_unit_cells(F.col("latitude"), F.col("longitude"), metres))
    apart = G.haversine(F.col("latitude"), F.col("longitude"), F.col("near_latitude"), F.col("near_longitude"))
    return own.join(other, ["_x", "_y", "_z"]).drop("_x", "_y", "_z").withColumn("metres", apart).where(F.col("metres") <= metres)


def _looked_up(left: DataFrame, right: DataFrame, on: Sequence[str], or_null: Sequence[str] = ()) -> DataFrame:
    """left with the other columns of right, which has one row for each value of `on` and `or_null`; in `or_null` null equals null.

    As no key of right repeats, its parts are even and are hashed; left, the long side, isn't sorted.
    """
    keys = [*on, *or_null]
    right = right.select(*(F.col(c).alias(f"_on_{c}") if c in keys else F.col(c) for c in right.columns))
    test = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) if c in or_null else F.col(c) == F.col(f"_on_{c}") for c in keys))
    return left.join(right.hint("shuffle_hash"), test, "left").drop(*(f"_on_{c}" for c in keys))


def resolve_access(requests: DataFrame, profiles: DataFrame, destinations: DataFrame, at: datetime, same: Sequence[str], transit: bool = True) -> DataFrame:
    """How each request is answered: the first tier that has a profile.

    1. cached_exact_property: current, of the same property and within 20 m of the
       request where that has coordinates; the freshest, then the largest id.
    2. cached_exact_origin: current and within 3 m, whatever its property.
    3. same_stop_reuse (transit): current, from the same stop; only the walk to
       the stop is replaced, the confidence falls to 0.9 of its own.
    4. nearby_origin_estimate (walking, cycling): the nearest current profile
       within 125 m (then the freshest), plus a connector at the mode's speed over
       1.35 times the gap; the confidence falls with the gap.
    5. stale: the freshest of tiers 1 and 2 that isn't current, never to be shown as current.
    6. straight_line_estimate (walking, cycling), with both ends known.
    7. pending_provider with both ends known, else unavailable.

    requests: request_id (unique), property_id, latitude, longitude,
    nearest_stop_id, walking_to_stop_seconds; profiles: profile_id, property_id,
    latitude, longitude, nearest_stop_id, duration, shortest, longest, distance,
    walking, confidence, to_destination, origin_walk, calculated_at, is_stale,
    expires_at; both hold travel_mode and the columns of `same` (travel_mode
    among them), which must be equal, null to null.  destinations: hotspot_id,
    latitude, longitude.  Profiles are reduced to the best of each property and
    point before any join: what isn't current never matters where something
    current is.  Points are compared once for all that share them, and requests
    are shuffled once for each of the three tables that they look up (property,
    point, stop), which have at most one row per key; transit=False says that no
    request is by transit and leaves the stops out.
    """
    same = list(same)
    moment = F.lit(at)
    current = ~F.col("is_stale") & F.coalesce(F.col("expires_at") > moment, F.lit(True))
    rows = profiles.withColumns({"_same": F.struct(*same), "_current": current, "_fresh": F.struct("calculated_at", "profile_id"), "_v": F.struct(*_FIELDS)}).where("_current is not null")
    asked = requests.select("request_id", "property_id", "latitude", "longitude", "nearest_stop_id", "walking_to_stop_seconds", F.struct(*same).alias("_same"), F.col("hotspot_id").alias("_goal"), F.col("travel_mode").alias("_mode"))

    # tier 1, and its share of tier 5; the best of each property and point is the freshest that is current, else the freshest
    best = F.max(F.struct("_current", "_fresh", "_v")).alias("_b")
    spots = rows.where("property_id is not null").groupBy("property_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "_same").agg(best)
    apart = G.haversine(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    own = asked.where("property_id is not null").select("property_id", "latitude", "longitude").distinct().join(spots, "property_id").where(~located | F.coalesce(apart <= PROPERTY_METRES, F.lit(False)))
    by_property = own.groupBy("property_id", "latitude", "longitude", "_same").agg(F.max("_b").alias("_p"))

    # tiers 2 and 4, and their share of tier 5: what is exact and current goes before what is near, and that before what is exact and stale
    at_point = rows.groupBy(F.col("latitude").alias("near_latitude"), F.col("longitude").alias("near_longitude"), "_same").agg(best)
    close = near_points(asked, rows, NEAR_METRES).join(at_point, ["near_latitude", "near_longitude"])
    exact, live = F.col("metres") <= ORIGIN_METRES, F.col("_b._current")
    tier = F.when(exact & live, _EXACT).when(live & F.col("_same.travel_mode").isin(*KMH), _NEAR).when(exact & ~live, _STALE)
    found = close.withColumn("_tier", tier).where("_tier is not null")
    found = found.withColumn("_q", F.struct("_tier", F.when(F.col("_tier") == _NEAR, -F.col("metres")).alias("_nearer"), "_b._fresh", "_b._v", "metres"))
    by_point = found.groupBy("latitude", "longitude", "_same").agg(F.max("_q").alias("_q"))

    # tier 3
    via = rows.where((F.col("travel_mode") == "transit") & F.col("_current") & F.col("nearest_stop_id").isNotNull() & F.col("to_destination").isNotNull())
    by_stop = via.groupBy("nearest_stop_id", "_same").agg(F.max(F.struct("_fresh", "_v")).alias("_s")).select("nearest_stop_id", "_same", F.col("_s._v").alias("_s"))

    out = _looked_up(asked, by_property, ["property_id", "_same"], ["latitude", "longitude"])
    out = _looked_up(out, by_stop, ["nearest_stop_id", "_same"]) if transit else out.withColumn("_s", F.lit(None).cast(by_stop.schema["_s"].dataType))
    out = _looked_up(out, by_point, ["latitude", "longitude", "_same"])
    goal = destinations.select(F.col("hotspot_id").alias("_goal"), F.col("latitude").alias("_goal_lat"), F.col("longitude").alias("_goal_lon"))
    out = out.join(goal, "_goal", "left")

    # the tier first, then what it adds, then the values
    speed = F.when(F.col("_mode") == "walking", KMH["walking"]).when(F.col("_mode") == "cycling", KMH["cycling"]) * 1000 / 3600
    walk, point, straight = F.col("walking_to_stop_seconds"), F.col("_q._tier"), F.col("_straight")
    out = out.withColumns({"_speed": speed, "_straight": G.haversine(F.col("latitude"), F.col("longitude"), F.col("_goal_lat"), F.col("_goal_lon"))})
    tier = (
        F.when(F.col("_p._current"), 1).when(point == _EXACT, 2).when(F.col("_s").isNotNull() & walk.isNotNull(), 3).when(point == _NEAR, 4).when(F.col("_p").isNotNull() | F.col("_q").isNotNull(), 5)
        .when(straight.isNotNull() & F.col("_speed").isNotNull(), 6).when(straight.isNotNull(), 7).otherwise(8)
    )
    out = out.withColumn("_tier", tier)
    of_stop, near, line = (F.col("_tier") == n for n in (3, 4, 6))
    own_stale = F.col("_q").isNull() | (F.col("_p._fresh") >= F.col("_q._fresh"))
    used = F.when((F.col("_tier") == 1) | ((F.col("_tier") == 5) & own_stale), F.col("_p._v")).when(of_stop, F.col("_s")).otherwise(F.when(F.col("_tier") <= 5, F.col("_q._v")))
    out = out.select(
        "request_id", "property_id", "_same", "_mode", "_tier", "_speed", walk.alias("_walk"), used.alias("_v"), F.when(near, F.col("_q.metres")).alias("_gap"),
        F.when(line, F.round(straight / F.col("_speed"))).alias("_seconds"), F.when(line, F.round(straight)).alias("_metres"),
    )
    out = out.withColumn("_detour", F.coalesce(F.ceil(F.col("_gap") * DETOUR), F.lit(0))).withColumn("_more", F.when(near, F.ceil(F.col("_detour") / F.col("_speed"))).otherwise(F.lit(0)))

    v, walk = (lambda n: F.col(f"_v.{n}")), F.col("_walk")
    longer = walk - F.coalesce(v("origin_walk"), v("walking"), F.lit(0))
    span = lambda n: F.when(of_stop, F.when(v(n).isNotNull(), F.greatest(F.lit(0), v(n) + longer))).otherwise(v(n) + F.col("_more"))
    stated = F.when(F.coalesce(v("confidence"), F.lit(0.0)) == 0, UNSTATED).otherwise(v("confidence"))
    numbers = {
        "profile_id": F.when(~(of_stop | near), v("profile_id")),
        "source_profile_id": F.when(of_stop | near, v("profile_id")),
        "duration": F.when(of_stop, walk + v("to_destination")).otherwise(F.coalesce(v("duration") + F.col("_more"), F.col("_seconds"))),
        "shortest": span("shortest"),
        "longest": span("longest"),
        "distance": F.coalesce(v("distance") + F.col("_detour"), F.col("_metres")),
        "walking": F.when(of_stop, walk).otherwise(F.coalesce(v("walking"), F.when(F.col("_mode") == "walking", F.col("_seconds")))),
    }
    fall = F.when(near, 1 - NEARBY_FALL * F.col("_gap") / NEAR_METRES).otherwise(1.0)
    confidence = F.when(line, STRAIGHT).when(of_stop | near, F.round(stated * F.when(near, NEARBY).otherwise(SAME_STOP) * fall, 3)).otherwise(v("confidence"))
    return out.select(
        "request_id", "property_id", "_same.*", F.element_at(F.array(*map(F.lit, TIERS)), F.col("_tier")).alias("result_type"), (of_stop | near | line).alias("is_estimate"),
        *(x.cast("long").alias(n) for n, x in numbers.items()), confidence.cast("double").alias("confidence"), F.col("_gap").alias("connector_metres"),
    )
