"""The streaming operators on batches of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import settled
from ..streaming import lifecycle as S
from .frames import load
from .registry import query


@query("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    return S.windowed_counts(load(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_lifecycle_merge", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), l AS (SELECT user_id, max(CAST(ts AS DATE)) AS day FROM events GROUP BY 1), m AS (SELECT user_id, (SELECT count(*) FROM d WHERE d.day > l.day) AS missed FROM l)
  SELECT user_id AS listing_id, CASE WHEN missed = 0 THEN 'active' WHEN missed < 2 THEN 'possibly_removed' ELSE 'removed' END AS status, CAST(missed AS INT) AS missed FROM m""")
def stream_lifecycle_merge(spark, sf_dir):
    """Every day of events as a run, in order; each state is written before the next run."""
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("listing_id"), F.md5("event_type").alias("hash"), F.col("ts").alias("observed_at"))
    days = [r.day for r in events.select(F.to_date("observed_at").alias("day")).distinct().orderBy("day").collect()]  # a row per run
    state = S.read_state(spark, "", -1)
    for day in days:
        state = settled(S.merge_run(state, events.where(F.to_date("observed_at") == day)))
    return state.select("listing_id", "status", "missed")
