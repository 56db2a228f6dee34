"""Selecting rows by a table of keys without shuffling texts where the table is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

#: Keys up to which a table is broadcast (16 bytes each at most); a larger one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def row_key(*columns: str) -> Column:
    """128 bits that stand for the values of a row's columns; null differs from any value."""
    apart = [x for at, c in enumerate(columns) for x in (F.lit(at), F.col(c))]
    return F.struct(F.xxhash64(*apart).alias("a"), F.xxhash64(F.lit(-1), *reversed(apart)).alias("b"))


def _checked(ids: DataFrame, id_col: str) -> DataFrame:
    ids = durable(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is among ids; rows without id are left out."""
    return rows.join(_checked(ids, id_col), id_col, "left_semi")


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id isn't among ids; rows without id stay."""
    return rows.join(_checked(ids, id_col), id_col, "left_anti")
