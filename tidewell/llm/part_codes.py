"""Vector codes: parts of vectors assigned to codebook entries along a trie of their dimensions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import bounded, durable

#: Parts of a vector, entries of a part's codebook, rounds that move the entries, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Leaves of the trie that one step of the walk takes.
LEAVES = 1 << 14


def _limit(dims: int) -> int:
    """The largest size of an integer component: squared distances of whole vectors then fit 64 bits."""
    return math.isqrt(2**62 // max(dims, 1)) // 2


def _integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims rounded up to whole parts) integer components; a missing end is zero."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = float(_limit(dims))
    out = np.zeros((len(vectors), -(-dims // PARTS) * PARTS), dtype=np.int64)
    out[:, :dims] = np.clip(np.floor(SCALE * flat), -most, most).astype(np.int64).reshape(len(vectors), dims)
    return out


def _distinct(parts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, their weights, and which of them each row is."""
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    which = np.empty(len(rows), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    return rows[fresh], np.add.reduceat(weight[order], np.flatnonzero(fresh)) if len(rows) else weight, which


def trie_walk(parts: np.ndarray, books: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(leaves, entry, squared distance) of lexicographically sorted distinct parts, depth first.

    Row of parts: the part's number, then its components; a node of the trie is
    a distinct prefix.  Each node adds its dimension's squared differences to
    the distances that its parent has accumulated to all entries, so parts with
    a common prefix share them.  The walk goes down LEAVES leaves at a time, in
    their order, and keeps the open path's distances from one step to the next.
    books: (PARTS, entries, dimensions).  Of equal distances the lower entry wins.
    """
    depth = parts.shape[1]
    path: list[np.ndarray] = []  # the accumulated distances of the last leaf's ancestors, from the root down
    for lo in range(0, len(parts), LEAVES):
        rows = parts[lo : lo + LEAVES]
        before = parts[lo - 1] if lo else None
        fresh = np.zeros(len(rows), dtype=bool)  # whether a row's prefix of the level's length is a new node
        node_of = np.zeros(len(rows), dtype=np.int64)
        upper: np.ndarray | None = None
        closed = before is None
        next_path = []
        for level in range(depth):
            value = rows[:, level]
            fresh[1:] |= value[1:] != value[:-1]
            closed = closed or value[0] != before[level]
            heads = np.flatnonzero(fresh)
            heads = np.concatenate(([0], heads[heads > 0]))
            if level == 0:
                grown = np.zeros((len(heads), books.shape[1]), dtype=np.int64)
            else:
                entry = books[rows[heads, 0], :, level - 1]
                grown = upper[node_of[heads]] + (value[heads, None] - entry) ** 2
            if not closed:
                grown[0] = path[level]  # the node is the open path's own
            node_of = np.cumsum(fresh)
            upper = grown
            next_path.append(grown[-1])
        path = next_path
        entry = upper.argmin(axis=1)
        yield slice(lo, lo + len(rows)), entry, upper[np.arange(len(upper)), entry]


def _parts_of(vectors: pa.Array, dims: int) -> np.ndarray:
    """(rows * PARTS, 1 + components) part numbers and components."""
    own = _integers(vectors, dims).reshape(len(vectors) * PARTS, -1)
    return np.concatenate((np.tile(np.arange(PARTS), len(vectors))[:, None], own), axis=1)


def _counted(dims: int):
    def run(batches):
        for batch in batches:
            parts = _parts_of(batch.column(0), dims)
            rows, weight, _ = _distinct(parts, np.ones(len(parts), dtype=np.int64))
            yield pa.record_batch({"part": _lists(rows), "weight": pa.array(weight)})

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def _sums(books: np.ndarray):
    """(slot, n, sums) of the parts of each batch: weights and weighted components by part and entry."""

    def run(batches):
        count = np.zeros(PARTS * ENTRIES, dtype=np.int64)
        total = np.zeros((PARTS * ENTRIES, books.shape[2]), dtype=np.int64)
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            weight = batch.column(1).to_numpy()
            for leaves, entry, _ in trie_walk(rows, books):
                slot = rows[leaves, 0] * ENTRIES + entry
                np.add.at(count, slot, weight[leaves])
                for d in range(books.shape[2]):
                    np.add.at(total[:, d], slot, rows[leaves, 1 + d] * weight[leaves])
        some = np.flatnonzero(count)
        yield pa.record_batch({"slot": pa.array(some), "n": pa.array(count[some]), "sums": _lists(total[some])})

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    value = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), *more)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(value.isNotNull() & (F.size(value) > 0) & F.coalesce(finite, F.lit(False)))


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, rounds: int = ROUNDS) -> tuple[int, np.ndarray]:
    """(dimensions, codebooks): (PARTS, entries, dimensions of a part) integers, from all rows.

    The first entries are those of the ENTRIES smallest ids (of rows that share
    one, the smallest vector); the smallest id gives the model its length.
    Without ids there is no codebook.  An entry that no part is nearest to stays.

    Vectors are counted by distinct part first, in lexicographic ranges, so that
    copies are one leaf and a task's leaves share prefixes; each round is a walk
    of them and a sum by entry.  Only the sums of PARTS * ENTRIES entries come to
    the driver.
    """
    rows = _usable(vectors.select(id_col, vector_col), id_col, vector_col)
    named = rows.where("vec_id is not null")

    def smallest(of: DataFrame, n: int) -> pa.Array:  # ids first: vectors of a few ids are all that moves
        ids = [r.vec_id for r in of.select("vec_id").distinct().orderBy("vec_id").limit(n).collect()]
        return of.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").select("vector").toArrow()["vector"].combine_chunks()

    dims = sum(len(x) for x in smallest(named, 1))
    if not dims:
        return 0, np.zeros((PARTS, 0, 0), dtype=np.int64)
    start = smallest(named.where(F.size("vector") == dims), ENTRIES)
    books = _integers(start, dims).reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy()
    counted = rows.where(F.size("vector") == dims).select("vector").mapInArrow(_counted(dims), "part array<long>, weight long")
    parts = durable(counted.repartitionByRange("part").groupBy("part").agg(F.sum("weight").alias("weight")).sortWithinPartitions("part"))
    for _ in range(rounds):
        moved = parts.mapInArrow(_sums(books), "slot long, n long, sums array<long>").select("slot", "n", F.posexplode("sums").alias("at", "value"))
        moved = moved.groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        for r in moved:
            books[r.slot // ENTRIES, r.slot % ENTRIES, r["at"]] = int(r.value) // r.n
    return dims, books


def books_text(books: np.ndarray) -> str:
    """All integers of the codebooks by part, entry and position, with commas between."""
    return ",".join(map(str, books.ravel().tolist()))


def compress_vectors(vectors: DataFrame, model: tuple[int, np.ndarray], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error of each vector: its parts' nearest entries, two hex digits each, and its squared distance to them.

    Vectors that are null or empty, hold null, NaN or infinite components, or
    have another length than the model's are left out.  Components beyond the
    size that keeps errors within 64 bits (2**15 at 64 dimensions) count as that
    size.  A length that isn't a multiple of PARTS is filled up with zeros.  Ids
    may be null or repeat, each row has its own code; other columns are ignored.
    """
    dims, books = model
    rows = _usable(vectors, id_col, vector_col, F.col(label_col).alias("label")).where(F.size("vector") == dims)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        for batch in batches:
            parts = _parts_of(batch.column(1), dims)
            own, _, which = _distinct(parts, np.ones(len(parts), dtype=np.int64))
            entry, apart = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
            for leaves, nearest, distance in trie_walk(own, books):
                entry[leaves], apart[leaves] = nearest, distance
            codes = entry[which].reshape(-1, PARTS).astype(np.uint8)
            yield pa.record_batch({
                "vec_id": batch.column(0), "label": batch.column(2), "code": pa.array([c.tobytes().hex() for c in codes], pa.string()),
                "error": pa.array(apart[which].reshape(-1, PARTS).sum(axis=1)),
            })

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame, *, salts: int = 16) -> DataFrame:
    """Adds label_error, the errors summed over the rows of a label (nulls together; the largest long if beyond it).

    The sums of few labels are broadcast; of many they are joined by a shuffle
    that deals each label over `salts` parts.
    """
    coded = durable(coded)
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    total = bounded(total.select(F.col("label").alias("same"), "label_error"))
    dealt = coded.withColumn("salt_", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
    copies = total.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, F.col("label").eqNullSafe(F.col("same")) & (F.col("salt_") == F.col("part_"))).drop("same", "salt_", "part_")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of books_text."""
    return hashlib.sha256(books_text(books).encode()).hexdigest()
