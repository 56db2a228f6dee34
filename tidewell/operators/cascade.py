"""Invalidation carried along dependencies until nothing more is touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled

STALE = "kind string, id long, reason string, depth int"
#: Rows of a frontier up to which it is broadcast to the dependencies; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def invalidate(dependencies: DataFrame, seeds: DataFrame, stale: DataFrame | None = None, *, most_rounds: int = 100) -> DataFrame:
    """(kind, id, reason, depth) of all that goes stale now: the seeds and what depends on them, over any number of steps.

    dependencies: parent_kind, parent_id, kind, id; seeds: kind, id, reason.  A
    node takes the reason of its nearest stale parent, of equals the least.
    What `stale` holds from runs before is left out, as is what depends on it
    alone: a replay gives no rows.  Cycles end, as no node is touched twice.

    Each round joins only the nodes that the last one touched, which are unique,
    to the dependencies; its rows are written, so rounds don't plan or run those
    before them again, and survive lost executors.  More than most_rounds steps
    raise RuntimeError.
    """
    spark = dependencies.sparkSession
    edges = dependencies.where("parent_id is not null and id is not null").select("parent_kind", "parent_id", "kind", "id").distinct()
    known = spark.createDataFrame([], STALE) if stale is None else stale.select("kind", "id", "reason", "depth")
    front = seeds.where("id is not null").groupBy("kind", "id").agg(F.min("reason").alias("reason")).withColumn("depth", F.lit(0))
    front = settled(front.join(known, ["kind", "id"], "left_anti"))
    found = front
    for _ in range(most_rounds):
        n = front.count()
        if not n:
            return found
        touched = front.select(F.col("kind").alias("parent_kind"), F.col("id").alias("parent_id"), "reason", "depth")
        touched = F.broadcast(touched) if n <= BROADCAST_ROWS else touched
        reached = edges.join(touched, ["parent_kind", "parent_id"]).groupBy("kind", "id").agg(F.min("reason").alias("reason"), (F.first("depth") + 1).alias("depth"))
        front = settled(reached.join(known, ["kind", "id"], "left_anti").join(found, ["kind", "id"], "left_anti"))
        found = found.unionByName(front)
    raise RuntimeError(f"dependencies are more than {most_rounds} steps deep")
