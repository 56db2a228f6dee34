"""Versioned tables and imports: replays, late runs, races, killed runs, rollback."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.operators import imports
from tidewell.sources import versions
from tidewell.sources.scratch import scratch_path

DAY = [datetime(2024, 1, d) for d in range(1, 9)]


@pytest.fixture
def table(spark):
    return versions.VersionedTable(spark, scratch_path(spark, "table"))


def ids(table):
    return sorted(r.id for r in table.read().collect())


def rows(spark, *values):
    return spark.createDataFrame([(v, f"t{v}") for v in values], "id int, text string")


def test_runs_in_turn(spark, table):
    assert table.current() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.publish(rows(spark, 1, 2), "a", DAY[1])[0] == "promoted" and ids(table) == [1, 2]
    assert table.publish(rows(spark, 9), "a", DAY[5])[0] == "already_imported" and ids(table) == [1, 2]
    assert table.publish(rows(spark, 2, 1).coalesce(1), "b", DAY[2])[0] == "reused"  # equal rows in another order
    assert table.current().version == table.history()[-1].version
    for late in (DAY[2], DAY[0]):
        with pytest.raises(versions.OutOfOrderRun):
            table.publish(rows(spark, 3), "late", late)
    assert table.publish(rows(spark, 1, 1, 2), "c", DAY[3])[0] == "promoted" and ids(table) == [1, 1, 2]  # a repeated row counts
    assert [c.status for c in table.history()] == ["promoted", "reused", "promoted"]


def test_rollback_and_vacuum(spark, table):
    table.publish(rows(spark, 1), "a", DAY[0])
    with pytest.raises(FileNotFoundError):
        table.rollback()
    table.publish(rows(spark, 2), "b", DAY[1], {"n": 5})
    old = table.read()
    assert table.rollback().status == "rolled_back" and ids(table) == [1]
    assert table.publish(rows(spark, 2), "b", DAY[4])[0] == "already_imported"  # a run that was taken back isn't imported by accident
    assert [r.id for r in old.collect()] == [2]
    table.publish(rows(spark, 3), "c", DAY[2])
    left = table.stage(rows(spark, 4), "killed")[0]
    gone = table.vacuum(keep=1)
    assert left in gone and len(gone) == 2 and ids(table) == [3]
    assert table.rollback().rows == 1 and ids(table) == [1]


def test_appends(spark, table):
    assert table.append(rows(spark, 1), "a", DAY[0])[0] == "appended"
    assert table.append(rows(spark, 1, 2), "b", DAY[1])[1].rows == 3 and ids(table) == [1, 1, 2]
    assert table.append(rows(spark, 5), "a", DAY[4])[0] == "already_imported" and ids(table) == [1, 1, 2]
    table.stage(rows(spark, 6), "killed")
    assert len(table.vacuum()) == 1 and ids(table) == [1, 1, 2]
    assert table.rollback().rows == 1 and ids(table) == [1]


def test_a_killed_run_changes_nothing(spark, table, monkeypatch):
    table.publish(rows(spark, 1), "a", DAY[0])
    monkeypatch.setattr(versions.VersionedTable, "_commit", lambda self, **values: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.publish(rows(spark, 2), "b", DAY[1])
    monkeypatch.undo()
    assert ids(table) == [1] and "b" not in table.current().runs
    half = table._files.create(table._path(table._pointer(2)), False)  # killed while it wrote the pointer
    half.write(bytearray(b'{"number": 2, "versi'))
    half.close()
    assert ids(table) == [1]
    assert table.publish(rows(spark, 2), "b", DAY[1])[0] == "promoted" and ids(table) == [2] and table.current().number == 3


def test_rows_that_fail_are_not_promoted(spark, table):
    table.publish(rows(spark, 1), "a", DAY[0])
    broken = rows(spark, 1, 2).selectExpr("id", "assert_true(id < 2) is null as text")
    with pytest.raises(Exception, match="id"):
        table.publish(broken, "b", DAY[1])
    assert ids(table) == [1]


def test_staged_files_are_verified(spark, table, monkeypatch):
    real, calls = versions._fingerprint, []

    def changed(frame):  # what is read back lacks its rows
        calls.append(frame)
        n, a, b = real(frame)
        return [n, a, b] if len(calls) == 1 else [versions.F.lit(0).alias("n"), a, b]

    monkeypatch.setattr(versions, "_fingerprint", changed)
    with pytest.raises(versions.NotVerified):
        table.publish(rows(spark, 1), "a", DAY[0])
    assert table.current() is None


def test_two_runs_race(spark, table, monkeypatch):
    table.publish(rows(spark, 1), "a", DAY[0])
    other = versions.VersionedTable(spark, table.path)
    stage = versions.VersionedTable.stage

    def overtaken(self, frame, run_id):
        out = stage(self, frame, run_id)
        if run_id == "slow":
            other.publish(rows(spark, 7), "fast", DAY[2])
        return out

    monkeypatch.setattr(versions.VersionedTable, "stage", overtaken)
    with pytest.raises(versions.ConcurrentCommit):
        table.publish(rows(spark, 2), "slow", DAY[1])
    assert ids(table) == [7]


SNAPSHOT = "listing_id long, match_key string, price double, title string"


def state_of(table):
    return {r.listing_id: (r.status, r.missed, r.price, r.property_key) for r in table.read().collect()}


def test_imports(spark, table):
    go = lambda run, day, *data, **options: imports.import_run(table, spark.createDataFrame(list(data), SNAPSHOT), run, DAY[day], **options)
    status, commit, plan = go("r1", 0, (1, "k1", 10.0, "a"), (2, "k1", 20.0, "b"), (3, None, None, "c"), (4, "k4", 5.0, "d"), (4, "k4", 6.0, "d"), (None, "k9", 1.0, "e"))
    assert status == "promoted" and commit.summary["new_listings"] == 3 and commit.summary["rows_rejected"] == 3 and commit.summary["properties_created"] == 2 and commit.summary["rows_with_warnings"] == 1
    one = state_of(table)
    assert one[1][3] == one[2][3] != one[3][3] and 4 not in one
    assert sorted((r.listing_id, r.reason) for r in plan.reviews.collect()) == [(3, "missing_price")]

    status, commit, plan = go("r2", 1, (1, "k1", 11.0, "a"), (2, "k1", 20.0, "b"), (4, "k4", 5.0, "d"))
    assert [commit.summary[n] for n in ("new_listings", "updated_listings", "unchanged_listings", "possibly_removed_listings", "properties_reused")] == [1, 1, 1, 1, 1]
    assert sorted((r.listing_id, r.change, r.status) for r in plan.observations.collect()) == [(1, "updated", "active"), (3, "absent", "possibly_removed"), (4, "new", "active")]
    two = state_of(table)

    again, known, plan = go("r2", 1)
    assert (again, known.summary, plan) == ("already_imported", commit.summary, None) and state_of(table) == two
    with pytest.raises(versions.OutOfOrderRun):
        go("r0", 0, (1, "k1", 1.0, "a"))
    assert state_of(table) == two

    go("r3", 2, (1, "k4", 11.0, "a"), (2, "k1", 1.0, "b"), (2, "k1", 2.0, "b"))  # 3 is gone for a second run, 2 is unsafe, 1 moved to a place that is another's
    three = state_of(table)
    assert three[3][:2] == ("removed", 2) and three[2] == two[2] and three[4][:2] == ("possibly_removed", 1) and three[1][3] == two[1][3]
    assert table.current().summary["possible_property_duplicates"] == 1 and table.current().summary["review_items_created"] == 2
    _, commit, _ = go("r4", 3, (3, None, 7.0, "c"), lifecycle=False)
    assert commit.summary["relisted_listings"] == 1 and state_of(table)[4] == three[4]
    _, commit, _ = go("r5", 4)
    assert commit.summary["removed_listings"] == 1 and set(x[0] for x in state_of(table).values()) == {"possibly_removed", "removed"}


def test_fingerprint_is_the_sum_of_digests(spark):
    """Stored commits hold it, so it must not depend on how it is added up."""
    for n in (0, 1, 5000):
        some = spark.range(n).select("id", (F.col("id") * 3).cast("string").alias("a b"))
        found = some.agg(*versions._fingerprint(some)).first()
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("a b"), F.col("id")).cast("decimal(38,0)")).cast("string")  # noqa: B023, E731
        assert tuple(found) == tuple(some.agg(F.count("*"), total(1), total(2)).first())


@pytest.mark.parametrize("limit", (0, 100))
def test_import_reads_the_snapshot_in_one_grouping(spark, table, monkeypatch, limit):
    """Ids that repeat, in the state and not, and null ids, with stored match keys broadcast and shuffled; the plan has no checkpoint of whole rows."""
    monkeypatch.setattr(imports, "BROADCAST_KEYS", limit)
    first = spark.createDataFrame([(1, "k1", 1.0, "a"), (2, "k2", 2.0, None), (3, "k3", None, "c")], SNAPSHOT)
    imports.import_run(table, first, "r1", DAY[0])
    rows = [(1, "k1", 1.0, "a"), (1, "k1", 1.0, "a"), (None, "k7", 1.0, "n"), (None, None, None, None), (5, "k2", 1.0, "e"), (5, "k9", 1.0, "e"), (5, "k9", 1.0, "e"), (6, "k2", 3.0, "f"), (2, "k2", 2.0, None)]
    plan = imports.import_plan(spark.createDataFrame(rows, SNAPSHOT), table.read(), "r2")
    assert plan.summary == dict.fromkeys(imports.SUMMARY, 0) | {"new_listings": 1, "unchanged_listings": 1, "possibly_removed_listings": 1, "observations_inserted": 2, "properties_reused": 1, "rows_rejected": 7}
    got = {r.listing_id: (r.status, r.missed, r.match_key, r.last_run) for r in plan.state.collect()}
    assert got == {1: ("active", 0, "k1", "r1"), 2: ("active", 0, "k2", "r2"), 3: ("possibly_removed", 1, "k3", "r1"), 6: ("active", 0, "k2", "r2")}
    assert plan.rejected.count() == 7 and plan.properties.count() == 0
    assert plan.state.inputFiles()  # read by columns from files, not from whole checkpointed rows
