"""Readers of stage artifacts: everything arrives as text and is typed by named rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

DECISION_SCHEMA = "decision_id long, listing_id long, action string, created_at string"
MANIFEST_SCHEMA = (
    "run_id string, created_at_utc string, status string, canonical_for_import boolean, warnings array<string>, errors array<string>, "
    "approval struct<status: string, approved_by: string, acknowledged_warning_conditions: array<string>, canonical_csv_fingerprint: string>, "
    "stages map<string, struct<status: string, input_rows: long, output_rows: long, completed_at_utc: string, metrics: map<string, string>>>"
)
# The stages that a run goes through, in order.
RUN_STAGES = ("stage0", "stage1", "stage2", "stage3")
PROFILES_SCHEMA = "property_id long, profiles array<struct<profile_id: long, travel_mode: string, samples: array<struct<departure_at: string, duration_seconds: int>>>>"
SNAPSHOT_SCHEMA = "metadata struct<dataset: string>, features array<struct<id: long, attributes: map<string, string>>>"


def read_csv_strings(spark: SparkSession, path: str, *, line_breaks: bool = False) -> DataFrame:
    """A CSV with header as text columns; a byte order mark before the first name is dropped, nothing is inferred.

    line_breaks allows them in quoted fields; a file is then one task.
    """
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def typed(rows: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Text columns by kind: bool, int, double, list, json; others stay text. What can't be read is null."""
    def cast(name: str, kind: str) -> Column:
        value = F.col(name)
        if kind == "bool":
            return X.parse_bool(value)[0]
        if kind == "int":
            return X.parse_number(value, True)[0].cast("int")
        if kind == "double":
            return X.parse_number(value)[0]
        if kind == "list":
            return X.parse_list(value)
        if kind == "json":
            return F.from_json(value, "map<string,string>")
        raise ValueError(f"no such kind: {kind}")

    return rows.withColumns({n: cast(n, k) for n, k in kinds.items() if n in rows.columns})


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, id, attributes) of the features in snapshot documents."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).json(path)
    return rows.select("metadata.dataset", F.explode("features").alias("f")).select("dataset", "f.id", "f.attributes")


def read_decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decisions, broken lines) of a JSON-lines log."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    rows = rows.withColumn("d", F.from_json("value", DECISION_SCHEMA))
    good = F.col("d.decision_id").isNotNull()
    return rows.where(good).select("d.*"), rows.where(~F.coalesce(good, F.lit(False))).select(F.col("value").alias("line"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(property_id, profile_id, travel_mode, departure_at, duration_seconds), a row per sample; profiles without samples have one."""
    rows = spark.read.schema(PROFILES_SCHEMA).json(path)
    flat = rows.select("property_id", F.explode("profiles").alias("p")).select("property_id", "p.profile_id", "p.travel_mode", F.explode_outer("p.samples").alias("s"))
    return flat.select("property_id", "profile_id", "travel_mode", "s.*")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per run manifest (JSON documents): its fields, stages as a map, and `problems`.

    Problems, in order: not_json, no_run_id, time_not_read, a stage that is
    missing or not completed, rows out of a stage that aren't those into the
    next (where both are stated), errors, a run for import without approval, and
    warnings that the approval doesn't acknowledge.
    """
    rows = spark.read.text(path, wholetext=False).where("trim(value) <> ''").select("value", F.from_json("value", MANIFEST_SCHEMA).alias("m"))
    rows = rows.select("m.*", F.coalesce(F.get_json_object("value", "$").isNull(), F.lit(True)).alias("_broken"))
    stage = lambda n: F.try_element_at("stages", F.lit(n))
    approved = F.coalesce(F.col("approval.status") == "approved", F.lit(False))
    left = F.array_except(F.coalesce("warnings", F.array().cast("array<string>")), F.coalesce("approval.acknowledged_warning_conditions", F.array().cast("array<string>")))
    found = [F.when(F.col("_broken"), "not_json"), F.when(~F.col("_broken") & (F.coalesce(F.trim("run_id"), F.lit("")) == ""), "no_run_id"), F.when(F.col("run_id").isNotNull() & F.col("created_at_utc").try_cast("timestamp").isNull(), "time_not_read")]
    found += [F.when(F.col("run_id").isNotNull() & stage(n).isNull(), f"missing_{n}").when(stage(n)["status"] != "completed", f"not_completed_{n}") for n in RUN_STAGES]
    found += [F.when(stage(a)["output_rows"] != stage(b)["input_rows"], f"rows_differ_{b}") for a, b in zip(RUN_STAGES, RUN_STAGES[1:], strict=False)]
    found += [F.when(F.size("errors") > 0, "errors"), F.when(F.col("canonical_for_import") & ~approved, "not_approved"), F.when(approved & (F.size(left) > 0), "warnings_not_acknowledged")]
    return rows.withColumn("problems", F.filter(F.array(*found), lambda p: p.isNotNull())).drop("_broken")


def page_links(pages: DataFrame, html: str = "html") -> Column:
    """Targets of all links of a page."""
    return F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit('<a href="([^"]*)"'), F.lit(1))


def absolute(url: Column, target: Column) -> Column:
    """A root-relative target on the page's host; others as they are."""
    return F.when(target.startswith("/"), F.concat(F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1), target)).otherwise(target)


def violations(rows: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """(key, problem): a row for each check that a row fails; a null result fails."""
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())
    return rows.select(key, F.explode(found).alias("problem"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with header in the declared column order."""
    rows.select(*columns).write.option("header", True).option("escape", '"').csv(path)


def write_json_lines(rows: DataFrame, path: str, key: str) -> None:
    """JSON lines, globally sorted by key."""
    rows.orderBy(key).write.option("ignoreNullFields", False).json(path)


def upsert_by_key(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows replaced by new ones of the same key, new keys added; one row per key of new."""
    fresh = new.dropDuplicates([key])
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def schema_of(kinds: Mapping[str, str]) -> T.StructType:
    """Text schema of the named columns."""
    return T.StructType([T.StructField(n, T.StringType()) for n in kinds])
