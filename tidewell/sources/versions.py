"""Versioned tables in a folder that the cluster shares: stage, verify, flip one pointer, keep what was there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class OutOfOrderRun(ValueError):
    """The run was observed no later than one that is already in."""


class NotVerified(RuntimeError):
    """What was read back from the staged files isn't what was written."""


class ConcurrentCommit(RuntimeError):
    """Another run committed first; nothing was changed."""


@dataclass(frozen=True)
class Commit:
    """One pointer file: the version that readers see (folders with commas between), and what led to it."""

    number: int
    version: str
    run_id: str
    status: str
    rows: int
    fingerprint: str
    observed_at: str
    before: str | None = None
    runs: Mapping[str, str] = field(default_factory=dict)
    summary: Mapping[str, int] = field(default_factory=dict)


_DIGESTS = ("__row_digest_1", "__row_digest_2")


def _digests(rows: DataFrame) -> list[Column]:
    """Two 64-bit digests of a row, of a struct of its columns, which Spark hashes in small methods; the columns of digested rows."""
    if set(_DIGESTS) <= set(rows.columns):
        return [F.col(n) for n in _DIGESTS]
    row = F.struct(*(F.col(f"`{n}`") for n in sorted(rows.columns)))
    return [F.xxhash64(F.lit(seed), row) for seed in (1, 2)]


def _digested(rows: DataFrame) -> DataFrame:
    """The rows with their digests as columns: what is observed isn't compiled, so it only adds up."""
    return rows.withColumns(dict(zip(_DIGESTS, _digests(rows), strict=True)))


def _fingerprint(rows: DataFrame) -> list:
    """Aggregates that are equal for equal bags of rows, in any order and however they are dealt."""

    def total(digest: Column) -> Column:
        """The sum of the digests, from the sums of three parts of them: longs add up faster than decimals."""
        parts = (F.shiftright(digest, 42), F.shiftright(digest, 21).bitwiseAND(F.lit(2**21 - 1)), digest.bitwiseAND(F.lit(2**21 - 1)))
        high, middle, low = (F.sum(p).cast("decimal(20,0)") for p in parts)
        return (high * F.lit(2**42).cast("decimal(14,0)") + middle * F.lit(2**21).cast("decimal(8,0)") + low).cast("decimal(38,0)").cast("string")

    return [F.count("*").alias("n"), *(total(d).alias(n) for d, n in zip(_digests(rows), "ab", strict=True))]


class VersionedTable:
    """A table whose versions are folders of Parquet and whose current one is named by the last pointer file.

    publish stages a version in a folder of its own, reads it back and compares
    count and fingerprint with what went in, and only then creates the next
    numbered pointer file.  Its creation is the commit: it fails if the file is
    there, so of two runs that race one wins and the other changes nothing, and
    a run that is killed at any point before leaves readers with the old version.
    Old versions stay until vacuum, for rollback and for readers on their way.

    Files are reached by Hadoop's file systems, as Spark reaches its own, so the
    folder may be on any store whose create-if-absent is atomic.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, number: int) -> str:
        return f"{self.path}/pointers/{number:012d}.json"

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/pointers")
        if not self._files.exists(folder):
            return []
        names = (x.getPath().getName() for x in self._files.listStatus(folder))
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)

    def _load(self, number: int) -> Commit | None:
        """The commit of a pointer file; None if its writer was killed halfway."""
        stream = self._files.open(self._path(self._pointer(number)))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()
        try:
            return Commit(**json.loads(text))
        except (ValueError, TypeError):
            return None

    def history(self) -> list[Commit]:
        """All commits, newest first."""
        return [c for n in self._numbers() if (c := self._load(n)) is not None]

    def current(self) -> Commit | None:
        """The last commit."""
        return next((c for n in self._numbers() if (c := self._load(n)) is not None), None)

    def read(self, commit: Commit | None = None) -> DataFrame:
        """The rows of a commit's version, of the current one by default."""
        commit = commit or self.current()
        if commit is None:
            raise FileNotFoundError(f"{self.path} holds no version")
        return self.spark.read.parquet(*(f"{self.path}/versions/{v}" for v in commit.version.split(",")))

    def _commit(self, **values) -> Commit:
        number = next(iter(self._numbers()), 0) + 1
        if values.pop("after") != number - 1:
            raise ConcurrentCommit(self.path)
        commit = Commit(number=number, **values)
        try:
            stream = self._files.create(self._path(self._pointer(number)), False)
        except Exception as error:
            if "exist" in str(error).lower():
                raise ConcurrentCommit(self.path) from error
            raise
        try:
            stream.write(bytearray(json.dumps(asdict(commit)).encode()))
        finally:
            stream.close()
        return commit

    def stage(self, rows: DataFrame, run_id: str) -> tuple[str, int, str]:
        """(version, rows, fingerprint) of a verified copy that no reader sees yet."""
        version = f"{run_id}-{uuid.uuid4().hex}"
        seen = Observation()
        digested = _digested(rows)
        digested.observe(seen, *_fingerprint(digested)).drop(*_DIGESTS).write.parquet(f"{self.path}/versions/{version}")
        wrote = seen.get
        stored = self.spark.read.parquet(f"{self.path}/versions/{version}")
        digested = _digested(stored)
        found = digested.agg(*_fingerprint(digested)).first().asDict()
        if found != wrote:
            raise NotVerified(f"{self.path}: wrote {wrote}, found {found}")
        kinds = ",".join(sorted(f"{x.name} {x.dataType.simpleString()}" for x in stored.schema))
        return version, found["n"], f"{found['n']}:{found['a']}:{found['b']}:{kinds}"

    def already(self, run_id: str, observed_at: datetime) -> Commit | None:
        """The current commit if it has the run; OutOfOrderRun if a later or simultaneous run is in."""
        before = self.current()
        if before is not None and run_id in before.runs:
            return before
        if before is not None and observed_at.isoformat() <= max(before.runs.values()):
            raise OutOfOrderRun(f"{run_id} of {observed_at.isoformat()} is not after {max(before.runs.values())}")
        return None

    def publish(self, rows: DataFrame, run_id: str, observed_at: datetime, summary: Mapping[str, int] | None = None) -> tuple[str, Commit]:
        """(status, commit): promoted; reused, where the rows are those of the current version; already_imported, where the run is in.

        Times are compared as ISO text and should be of one zone.  A run that isn't after the last raises OutOfOrderRun.
        """
        numbers = self._numbers()
        if (known := self.already(run_id, observed_at)) is not None:
            return "already_imported", known
        before = self.current()
        version, n, fingerprint = self.stage(rows, run_id)
        same = before is not None and before.fingerprint == fingerprint
        if same:
            self._files.delete(self._path(f"{self.path}/versions/{version}"), True)
        runs = {**(before.runs if before else {}), run_id: observed_at.isoformat()}
        commit = self._commit(
            after=next(iter(numbers), 0), version=before.version if same else version, run_id=run_id, status="reused" if same else "promoted", rows=n, fingerprint=fingerprint, observed_at=observed_at.isoformat(),
            before=before.before if same else before.version if before else None, runs=runs, summary=dict(summary or {}),
        )
        return commit.status, commit

    def append(self, rows: DataFrame, run_id: str, observed_at: datetime, summary: Mapping[str, int] | None = None) -> tuple[str, Commit]:
        """(status, commit): as publish, but the version is the current one's folders and the staged one, which alone is written."""
        numbers = self._numbers()
        if (known := self.already(run_id, observed_at)) is not None:
            return "already_imported", known
        before = self.current()
        version, n, fingerprint = self.stage(rows, run_id)
        runs = {**(before.runs if before else {}), run_id: observed_at.isoformat()}
        commit = self._commit(
            after=next(iter(numbers), 0), version=f"{before.version},{version}" if before else version, run_id=run_id, status="appended", rows=n + (before.rows if before else 0),
            fingerprint=f"{before.fingerprint}+{fingerprint}" if before else fingerprint, observed_at=observed_at.isoformat(), before=before.version if before else None, runs=runs, summary=dict(summary or {}),
        )
        return commit.status, commit

    def rollback(self) -> Commit:
        """A new commit that names the version before the current one; runs stay in the ledger, so they aren't imported again."""
        numbers = self._numbers()
        now = self.current()
        if now is None or now.before is None:
            raise FileNotFoundError(f"{self.path} has no version to go back to")
        then = next(c for c in self.history() if c.version == now.before)
        return self._commit(after=next(iter(numbers), 0), version=then.version, run_id=then.run_id, status="rolled_back", rows=then.rows, fingerprint=then.fingerprint, observed_at=then.observed_at, before=then.before, runs=now.runs, summary=then.summary)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes and returns the versions that the last `keep` commits neither name nor would go back to: older ones and what killed runs staged."""
        used = {v for c in self.history()[:keep] for vs in (c.version, c.before) if vs for v in vs.split(",")}
        folder = self._path(f"{self.path}/versions")
        gone = [x.getPath().getName() for x in self._files.listStatus(folder) if x.getPath().getName() not in used] if self._files.exists(folder) else []
        for name in gone:
            self._files.delete(self._path(f"{self.path}/versions/{name}"), True)
        return gone
