"""Every registered query of the library against its SQL on the smallest tables, and the flagship's schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewell.plans import all_queries
from tidewell.plans.frames import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection


#: Queries that find nothing on the smallest tables.
EMPTY = {"agg_distinct_shared", "set_unique_violations", "transit_destination_routes"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(plain(x) for _, x in sorted(value.asDict().items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if getattr(value, "tzinfo", None):
        return value.replace(tzinfo=None)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    rows = all_queries.QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    if name not in all_queries.ORACLE:
        assert got
        return
    found = duck.execute(all_queries.ORACLE[name])
    assert got or name in EMPTY, "an empty result proves nothing"
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["listing_id", "level_no", "cohort_count", "median", "value_score", "price_percentile"] and rows.count() > 0


def test_registry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries.QUERIES) <= set(entry.queries())
