"""The listing lifecycle as a stream of runs: each micro-batch is merged into versioned state.

The reference processes runs one at a time; here a run is a micro-batch and the
state is a Parquet version per batch, so a batch that is retried after a
failure writes the same version again and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "listing_id long, status string, missed int, last_hash string, last_run timestamp"


def merge_run(state: DataFrame, run: DataFrame, removed_after: int = 2) -> DataFrame:
    """The state after a run of (listing_id, hash, observed_at); rows not newer than a listing's last run are late and ignored.

    A listing seen resets to active; one not seen counts up and is removed at
    removed_after.  An empty run changes nothing.
    """
    newest = Window.partitionBy("listing_id").orderBy(F.desc("observed_at"), F.desc("hash"))
    seen = run.withColumn("_k", F.row_number().over(newest)).where("_k = 1").select("listing_id", "hash", "observed_at")
    any_seen = F.broadcast(run.agg((F.count("*") > 0).alias("_run")))
    rows = state.join(seen, "listing_id", "full").join(any_seen)
    fresh = F.col("observed_at").isNotNull() & (F.col("last_run").isNull() | (F.col("observed_at") > F.col("last_run")))
    missed = F.when(fresh, 0).when(F.col("_run"), F.coalesce("missed", F.lit(0)) + 1).otherwise(F.col("missed"))
    status = F.when(fresh, "active").when(~F.col("_run"), F.col("status")).when(missed >= removed_after, "removed").otherwise("possibly_removed")
    return rows.select("listing_id", status.alias("status"), missed.cast("int").alias("missed"), F.when(fresh, F.col("hash")).otherwise(F.col("last_hash")).alias("last_hash"), F.when(fresh, F.col("observed_at")).otherwise(F.col("last_run")).alias("last_run"))


def read_state(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The state of a version; empty before the first."""
    if version < 0:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/version={version}")


def lifecycle_stream(runs: DataFrame, folder: str, checkpoint: str, removed_after: int = 2) -> StreamingQuery:
    """Starts the stream; micro-batch n reads version n - 1 and writes version n."""

    def apply(batch: DataFrame, number: int) -> None:
        state = read_state(batch.sparkSession, folder, number - 1)
        merge_run(state, batch, removed_after).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return runs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type over event-time windows; rows later than the watermark are dropped.

    The same plan runs on a batch and on a stream.
    """
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
