"""Snapshot against state: classification, transitions, versioned tables, set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON, names sorted and nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def classify_snapshot(snapshot: DataFrame, state: DataFrame, key: str, hash_col: str = "hash", status_col: str = "status") -> DataFrame:
    """(key, change): new, updated, unchanged, relisted or absent, from one full join."""
    new, old = snapshot.select(key, F.col(hash_col).alias("_h")), state.select(key, F.col(hash_col).alias("_g"), F.col(status_col).alias("_s"))
    rows = new.withColumn("_new", F.lit(True)).join(old.withColumn("_old", F.lit(True)), key, "full")
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "absent")
        .when(F.col("_s") == "removed", "relisted")
        .when(F.col("_h").eqNullSafe(F.col("_g")), "unchanged")
        .otherwise("updated")
    )
    return rows.select(key, change.alias("change"))


def lifecycle_transition(state: DataFrame, present: DataFrame, key: str, removed_after: int = 2) -> DataFrame:
    """The state's next status and missed count; presence resets, absence counts up to removed."""
    here = state.join(present.select(key).distinct().withColumn("_here", F.lit(True)), key, "left")
    missed = F.when(F.col("_here"), 0).otherwise(F.coalesce("missed", F.lit(0)) + 1)
    rows = here.withColumn("missed", missed)
    status = F.when(F.col("_here"), "active").when(F.col("status") == "removed", "removed").when(F.col("missed") >= removed_after, "removed").otherwise("possibly_removed")
    return rows.withColumn("status", status).drop("_here")


def append_once(rows: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't stored, one per key: what an idempotent append has to write."""
    return rows.dropDuplicates(list(key)).join(existing.select(*key).distinct(), list(key), "left_anti")


def scd2_merge(current: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str], at: Column) -> DataFrame:
    """The versioned table after a merge, with `action` per row: kept, closed, inserted.

    A key whose fields differ (null equals null) has its current row closed and
    a new one inserted; keys that are only in one input stay or are inserted.
    """
    old = current.select(key, *fields, "valid_from")
    new = incoming.select(key, *(F.col(f).alias(f"_{f}") for f in fields)).withColumn("_in", F.lit(True))
    rows = old.withColumn("_cur", F.lit(True)).join(new, key, "full")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    state = F.when(F.col("_in").isNull(), "kept").when(F.col("_cur").isNull(), "new").when(same, "kept").otherwise("changed")
    rows = rows.withColumn("_state", state)
    none = F.lit(None).cast("timestamp")
    closed = rows.where("_state in ('kept', 'changed')").select(
        key, *fields, "valid_from", F.when(F.col("_state") == "changed", at).otherwise(none).alias("superseded_at"), (F.col("_state") == "kept").alias("is_current"), F.when(F.col("_state") == "changed", "closed").otherwise("kept").alias("action")
    )
    opened = rows.where("_state in ('new', 'changed')").select(key, *(F.col(f"_{f}").alias(f) for f in fields), at.alias("valid_from"), none.alias("superseded_at"), F.lit(True).alias("is_current"), F.lit("inserted").alias("action"))
    return closed.unionByName(opened)


def keep_better(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Geocode upsert: the new row wins unless the stored one is ok and the new isn't at least as sure."""
    fields = ("status", "latitude", "confidence")
    rows = stored.select(*key, F.struct(*fields).alias("_o")).join(new.select(*key, F.struct(*fields).alias("_n")), list(key), "full")
    better = F.col("_o").isNull() | (
        F.col("_n").isNotNull()
        & (
            ~(F.col("_o.status").eqNullSafe(F.lit("ok")))
            | ((F.col("_n.status") == "ok") & F.col("_n.latitude").isNotNull() & (F.coalesce("_n.confidence", F.lit(0.0)) >= F.coalesce("_o.confidence", F.lit(0.0))))
        )
    )
    better = F.coalesce(better, F.lit(False))
    return rows.select(*key, F.when(better, F.col("_n")).otherwise(F.col("_o")).alias("_v"), F.when(better, "new").otherwise("stored").alias("origin")).select(*key, "_v.*", "origin")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one input has."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    rows = a.join(b, key, "full").where("_a is null or _b is null")
    return rows.select(key, F.when(F.col("_a").isNull(), "unexpected").otherwise("missing").alias("side"))


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_ads(rows: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """(key, group, members): rows that agree in all of `same` (none null) with at least one other; the group is named by its least key."""
    full = rows.where(" and ".join(f"{c} is not null" for c in same)).select(key, *same).distinct()
    groups = full.groupBy(*same).agg(F.count("*").alias("members"), F.min(key).alias("group")).where("members > 1")
    return full.join(groups, list(same)).select(key, "group", "members")


def discovery_health(runs: DataFrame, order: str, found: str, least: int, drop_ratio: float = 0.5) -> DataFrame:
    """Adds warnings: no result, below the minimum, or a substantial drop from the run before."""
    before = F.lag(found).over(Window.orderBy(order))  # a row per run
    parts = (
        F.when(F.col(found) == 0, "zero_results"),
        F.when((F.col(found) > 0) & (F.col(found) < least), "below_minimum"),
        F.when(before.isNotNull() & (F.col(found) < before * drop_ratio), "substantial_drop"),
    )
    rows = runs.withColumn("warnings", F.array(*parts))
    return rows.withColumn("warnings", F.filter("warnings", lambda x: x.isNotNull()))


def property_resolution(listings: DataFrame, stored_links: DataFrame, stored_keys: DataFrame) -> DataFrame:
    """Each listing's property: the stored link's, else the one with its match key, else a new key.

    Properties are never merged by likeness; listings without a match key get
    one of their own.
    """
    rows = listings.join(stored_links.select("listing_id", F.col("property_id").alias("_link")), "listing_id", "left")
    rows = rows.join(stored_keys.select("match_key", F.col("property_id").alias("_key")), "match_key", "left")
    made = F.concat(F.lit("new-"), F.substring(F.sha2(F.coalesce("match_key", F.concat(F.lit("listing:"), F.col("listing_id").cast("string"))), 256), 1, 16))
    how = F.when(F.col("_link").isNotNull(), "link").when(F.col("_key").isNotNull(), "match_key").otherwise("created")
    return rows.select("listing_id", F.coalesce(F.col("_link").cast("string"), F.col("_key").cast("string"), made).alias("property"), how.alias("resolution"))
