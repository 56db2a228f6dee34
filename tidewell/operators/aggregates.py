"""Aggregations shared by several reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def distribution(rows: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES, digits: int = 4) -> DataFrame:
    """Count, minimum, exact quantiles, maximum and mean of the non-null values, rounded.

    Equal values are counted first, so the percentile of a group holds distinct
    values with frequencies.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    at = [F.round(F.expr(f"percentile(_v, {p}D, _n)"), digits).alias(f"p{round(p * 100)}") for p in quantiles]
    found = counted.groupBy(*by).agg(F.sum("_n").alias("n"), F.round(F.min("_v"), digits).alias("min"), *at, F.round(F.max("_v"), digits).alias("max"), F.round(F.sum(F.col("_v") * F.col("_n")) / F.sum("_n"), digits).alias("mean"))
    every = rows.select(*by).distinct()
    same = F.lit(True)
    left, right = every.alias("e"), found.alias("f")
    for c in by:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}"))
    stats = ["min", *(f"p{round(p * 100)}" for p in quantiles), "max", "mean"]
    return left.join(right, same, "left").select(*(f"e.{c}" for c in by), F.coalesce("f.n", F.lit(0)).alias("n"), *(f"f.{s}" for s in stats))


def status_counts(rows: DataFrame, label: Column, name: str = "label", unknown: str = "unknown") -> DataFrame:
    """Rows by label, nulls under `unknown`."""
    return rows.groupBy(F.coalesce(label, F.lit(unknown)).alias(name)).agg(F.count("*").alias("n"))


def conditional_counts(rows: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One count per named condition, in one pass; null conditions don't count."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def bucket_label(value: Column, edges: Sequence[float]) -> Column:
    """`low-high` label of the half-open bucket [low, high); `high+` beyond the last edge, null below the first."""
    label = F.when(value >= edges[-1], f"{edges[-1]:g}+")
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        label = label.when((value >= low) & (value < high), f"{low:g}-{high:g}")
    return label


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value): the distinct non-null values of each column, long form.

    One Expand and one partial aggregation for all fields.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
