"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

The plan, in five steps.
1. One Arrow pass makes each text's shingle-set size, a 128-bit digest of the
   set and its signature.  Texts with equal sets form a class at once; the
   digest names it and one text stands for it, so copies are never paired.
2. Band keys of the classes are counted; keys of one class alone are dropped.
3. In each bucket the member that shares most buckets with others is the hub.
   Buckets with one hub form a family, so the bands of a family collapse.
4. A family is split into blocks of bounded text.  A task per block confirms
   links on full shingle sets, to the hub first, and returns a spanning forest.
   Members that it leaves outside the hub's tree are dealt into blocks of their
   own, which meet the family's other blocks.  Pairs in one tree and pairs whose
   signatures rule the threshold out are passed over.
5. Star contraction joins the forests; a component is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .durable import durable
from .graph import connected_components
from .ids import row_key, with_ids

REGISTERS, BAND_ROWS = 128, 4
#: Signature agreement may fall short of the similarity by this much (over 5.5 standard deviations at 0.8: a pair is lost with 1e-8, as by the bands).
MARGIN = 0.2
#: Shingles that a block holds, about.
BLOCK_SHINGLES = 200_000


def _sets(column, k: int):
    """(row, sorted distinct shingle hashes) and the slice's grams, slice by slice."""
    for first, end, data, offs in kernel.slices(column):
        data = kernel.LOWER[data]
        starts, ends, words = kernel.word_spans(data, offs, kernel.NON_SPACE)
        grams, begin = kernel.gram_hashes(kernel.span_hashes(data, starts, ends), words, k)
        yield first, end, grams, begin


def _digest(grams: np.ndarray) -> bytes:
    """16 bytes that name a set of distinct grams."""
    salted = grams ^ kernel._STEP[61]
    return kernel.mix(grams.copy()).sum().tobytes() + kernel.mix(salted).sum().tobytes()


def _profiles(k: int):
    def run(batches):
        for batch in batches:
            for first, end, grams, begin in _sets(batch["text"], k):
                signatures = kernel.super_minhash(grams, begin, REGISTERS)
                parts = signatures.astype(np.uint64).reshape(len(signatures), -1, BAND_ROWS)
                keys = (parts * kernel._STEP[:BAND_ROWS]).sum(axis=2) + np.arange(parts.shape[1], dtype=np.uint64) * kernel._STEP[60]
                keys = kernel.mix(keys).astype(np.int64)
                small = (signatures & np.uint32(255)).astype(np.uint8)
                sets = [np.unique(grams[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                rows = batch.slice(first, end - first)
                yield pa.record_batch(
                    {c: rows[c] for c in rows.schema.names if c != "text"}
                    | {
                        "n_shingles": pa.array(n),
                        "cls": pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        "bands": pa.array([x if c else None for x, c in zip(keys, n, strict=True)], pa.list_(pa.int64())),
                        "signature": pa.array([x.tobytes() if c else None for x, c in zip(small, n, strict=True)], pa.binary()),
                    }
                )

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


class _Members:
    """Classes of a task with their sets, sizes and signatures, a tree for each and the links found."""

    def __init__(self, table: pa.Table, k: int, order):
        sets: list[np.ndarray] = []
        for _, _, grams, begin in _sets(table["text"], k):
            sets += [np.unique(grams[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        rows = {c: i for i, c in enumerate(table["cls"].to_pylist())}
        if wrong := [c for c, i in rows.items() if _digest(sets[i]) != c]:
            raise ValueError(f"{len(wrong)} classes came with another's text")
        self.classes = sorted(rows, key=order)
        self.rows = np.array([rows[c] for c in self.classes], dtype=np.int64)
        self.sets = [sets[i] for i in self.rows]
        self.sizes = np.array([len(s) for s in self.sets])
        raw = table["signature"].to_pylist()
        self.marks = np.frombuffer(b"".join(raw[i] for i in self.rows), np.uint8).reshape(len(self.classes), REGISTERS)
        self.tree = np.arange(len(self.classes))
        self.found: list[tuple[bytes, bytes]] = []

    def meet(self, i: int, others: np.ndarray, percent: int) -> None:
        """Links member i to all of the others that are near it and not yet in its tree."""
        sizes, tree = self.sizes, self.tree
        others = others[(tree[others] != tree[i]) & (percent * np.maximum(sizes[others], sizes[i]) <= 100 * np.minimum(sizes[others], sizes[i]))]
        if not len(others):
            return
        near = (self.marks[others] == self.marks[i]).mean(axis=1)
        likely = near >= percent / 100 - MARGIN
        for j in others[likely][np.argsort(-near[likely], kind="stable")]:
            if tree[j] != tree[i] and _linked(self.sets[i], self.sets[j], percent):
                self.found.append((self.classes[i], self.classes[j]))
                tree[tree == tree[j]] = tree[i]


_FOUND = "a binary, b binary, hub binary"


def _found(links: list[tuple[bytes, bytes]], free: list[bytes], hub: bytes) -> pa.Table:
    """Links (a, b), and members a outside the hub's tree."""
    n = len(links)
    return pa.table(
        {
            "a": pa.array([a for a, _ in links] + free, pa.binary()),
            "b": pa.array([b for _, b in links] + [None] * len(free), pa.binary()),
            "hub": pa.array([None] * n + [hub] * len(free), pa.binary()),
        }
    )


def _block(k: int, percent: int):
    """Links within a block and to the hub; of a family of several blocks also who is outside the hub's tree."""

    def run(table: pa.Table) -> pa.Table:
        hub = table["hub"][0].as_py()
        m = _Members(table, k, lambda c: (c != hub, c))
        for i in range(len(m.classes) - 1):
            m.meet(i, np.arange(i + 1, len(m.classes)), percent)
        several = table["blocks"][0].as_py() > 1
        return _found(m.found, [c for i, c in enumerate(m.classes) if several and m.tree[i] != m.tree[0]], hub)

    return run


def _cell(k: int, percent: int):
    """Links of members outside the hub's tree to those of another block."""

    def run(table: pa.Table) -> pa.Table:
        m = _Members(table, k, lambda c: c)
        inside = ~table["free"].to_numpy()[m.rows]
        asks, block = table["asks"].to_numpy()[m.rows], table["block"].to_numpy()[m.rows]
        if inside.any():
            m.tree[inside] = np.flatnonzero(inside)[0]
        here = np.flatnonzero(block == table["other"][0].as_py())
        for i in np.flatnonzero(asks):
            m.meet(i, here[block[here] != block[i]], percent)
        return _found(m.found, [], b"")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and the columns in `keep`.

    Words are runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased; a document's set
    holds its distinct shingles, or its whole word sequence if that is shorter.
    Two documents link if 100 * intersection >= percent * union.  component_id
    is the smallest id reachable, kept tells whether it is the document's own.

    A null or empty text has no shingles, links with nothing and is its own
    component.  Rows are the nodes: those of one id with different texts each
    keep their own links.  Rows without an id link as others do but name no
    component: one without any id has component_id null, and of its rows those
    that equal one chosen text are kept.  Columns not in `keep` are ignored, an
    empty table gives no rows.
    """
    kept_columns = [F.struct(*keep).alias("keep")] if keep else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), *kept_columns, F.col(text_col).alias("text"))
    through = f", keep {docs.schema['keep'].dataType.simpleString()}" if keep else ""
    kernel.small_batches(docs.sparkSession)
    profile = durable(docs.mapInArrow(_profiles(shingle), f"doc_id long, key struct<a: long, b: long>{through}, n_shingles long, cls binary, bands array<long>, signature binary"))
    full, empty = profile.where("n_shingles > 0"), profile.where("n_shingles = 0")
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")  # ids first, then the smallest
    classes = durable(full.groupBy("cls").agg(F.min(lead).alias("lead"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "signature"))))

    keys = classes.select("cls", "n_shingles", F.explode("bands").alias("key"))
    shared = durable(keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    rows = durable(keys.join(shared, "key"))
    central = rows.groupBy("cls").agg(F.sum("members").alias("central"))
    hubs = durable(rows.join(central, "cls").groupBy("key").agg(F.max_by("cls", F.struct("central", "cls")).alias("hub")))
    family = durable(rows.join(hubs, "key").select("hub", "cls", "n_shingles").distinct())

    def blocks_of(members: DataFrame, name: str) -> DataFrame:
        return members.groupBy("hub").agg(F.ceil(F.sum(F.col("n_shingles") + 200) / BLOCK_SHINGLES).cast("int").alias(name))

    def dealt(name: str, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(name)).cast("int")

    def upto(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    blocks = durable(blocks_of(family, "blocks"))
    placed = family.join(blocks, "hub").withColumn("block", dealt("blocks", 0))
    def with_texts(members: DataFrame) -> DataFrame:
        """cls, signature and a text of the classes among members; other texts are not shuffled."""
        wanted = durable(classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "lead.key", "signature"))
        return wanted.join(with_ids(docs.select("key", "text"), wanted, "key").dropDuplicates(["key"]), "key").drop("key")

    star = placed.where("cls <> hub").select("hub", "blocks", "block", "cls").unionByName(blocks.select("hub", "blocks", upto("blocks").alias("block"), F.col("hub").alias("cls")))
    first = durable(star.join(with_texts(family), "cls").groupBy("hub", "block").applyInArrow(_block(shingle, percent), _FOUND))

    free = first.where("hub is not null").select("hub", F.col("a").alias("cls"))
    alone = durable(placed.where("blocks > 1").join(free.withColumn("free", F.lit(True)), ["hub", "cls"], "left").withColumn("free", F.coalesce("free", F.lit(False))))
    own = durable(blocks_of(alone.where("free"), "own_blocks"))
    alone = alone.join(own, "hub").withColumn("own", dealt("own_blocks", 1))  # families with members outside the hub's tree
    asking = alone.where("free").select("hub", "own", upto("blocks").alias("other"), "cls", "block", "free", F.lit(True).alias("asks"))
    asked = alone.select("hub", upto("own_blocks").alias("own"), F.col("block").alias("other"), "cls", "block", "free", F.lit(False).alias("asks"))
    cells = asking.where("other <> block").unionByName(asked)
    second = cells.join(with_texts(alone), "cls").groupBy("hub", "own", "other").applyInArrow(_cell(shingle, percent), _FOUND)

    links = connected_components(first.where("b is not null").select("a", "b").unionByName(second.select("a", "b")))
    rooted = durable(links.join(classes, links.node == classes.cls).select("cls", F.col("component").alias("root"), "lead"))
    least = durable(rooted.groupBy("root").agg(F.min("lead").alias("lead")))
    named = rooted.select("cls", "root").join(least, "root").select("cls", F.col("lead").alias("_lead"))
    known = durable(classes.select("cls", "lead").join(named, "cls", "left").select("cls", F.coalesce("_lead", "lead").alias("lead")))
    through = [F.col("keep").getField(c).alias(c) for c in keep]
    component = F.when(~F.col("lead.no_id"), F.col("lead.id"))
    kept = F.when(F.col("lead.no_id"), F.col("key") == F.col("lead.key")).otherwise(F.coalesce(F.col("doc_id") == F.col("lead.id"), F.lit(False)))
    out = full.join(known, "cls", "left").select("doc_id", "n_shingles", component.alias("component_id"), *through, kept.alias("kept"))
    return out.unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *through, F.lit(True).alias("kept")))
