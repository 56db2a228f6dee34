"""Total orders, pages and top rows; every order ends with an id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sort keys with their column and default direction.
SORTS = {
    "recommended": ("ranking_overall_score", "desc"),
    "overall_score": ("ranking_overall_score", "desc"),
    "value_score": ("ranking_value_score", "desc"),
    "campus_access_score": ("ranking_campus_access_score", "desc"),
    "transit_score": ("ranking_transit_score", "desc"),
    "price_low": ("price_monthly", "asc"),
    "price_high": ("price_monthly", "desc"),
    "distance": ("distance_km", "asc"),
    "newest": ("last_seen_at", "desc"),
}


def sort_order(sort: str, order: str | None = None, id_col: str = "listing_id") -> list[Column]:
    """The sort's column, nulls last in both directions, then the id."""
    column, usual = SORTS[sort]
    return [F.desc_nulls_last(column) if (order or usual) == "desc" else F.asc_nulls_last(column), F.asc(id_col)]


def page(rows: DataFrame, sort: str, limit: int, offset: int = 0, order: str | None = None, id_col: str = "listing_id") -> DataFrame:
    """One page of the sorted rows; Spark takes the first offset + limit of each partition only."""
    return rows.orderBy(*sort_order(sort, order, id_col)).offset(offset).limit(limit)


def top_per_key(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; Spark filters by rank before the shuffle too."""
    name = rank or "_rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def natural_labels(labels: Column) -> Column:
    """Numeric labels by number, then the others by text."""
    keyed = F.transform(labels, lambda x: F.struct(x.try_cast("int").isNull().alias("t"), x.try_cast("int").alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s.x)
