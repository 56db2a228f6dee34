"""Benchmark decontamination by winnowing: shared fingerprints, then extended hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Words of a window, of a fingerprint's gram, and grams of a winnowing window: any shared span of SPAN words shares a fingerprint.
SPAN, GRAM = 10, 5
WINNOW = SPAN - GRAM + 1
#: Bytes of benchmark text up to which its index is broadcast (about five times as large); beyond, fingerprints are joined.
BROADCAST_BYTES = 8 << 20

_LEAKS = "n_words long, n_hit long, item_ids array<string>, spans array<struct<first:int,last:int>>"


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and each row's first word."""
    data = kernel.LOWER[data]
    starts, ends, first = kernel.word_spans(data, offs, kernel.ALNUM)
    return kernel.span_hashes(data, starts, ends), first


def _fingerprints(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the chosen grams among the words, their hashes and their rows."""
    grams, begin = kernel.gram_hashes(words, first, GRAM)
    n = len(grams) - WINNOW + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, grams[:0], none
    row = np.repeat(np.arange(len(first) - 1), np.diff(begin))
    whole = row[:n] == row[WINNOW - 1 :]
    least = grams[:n].copy()
    for d in range(1, WINNOW):
        np.minimum(least, grams[d : d + n], out=least)
    chosen = np.zeros(len(grams), dtype=bool)
    for d in range(WINNOW):
        chosen[d : d + n] |= whole & (grams[d : d + n] == least)
    at = np.flatnonzero(chosen)
    return first[:-1][row[at]] + at - begin[:-1][row[at]], grams[at], row[at]


class Index:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, ids: list[str], texts: pa.Array):
        self.ids = ids
        marks, windows = [], {}
        for start, _, data, offs in kernel.slices(texts):
            words, first = _words(data, offs)
            marks.append(_fingerprints(words, first)[1])
            for item, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True), start):
                if b > a:
                    own, begin = kernel.gram_hashes(words[a:b], np.array([0, b - a]), n := min(SPAN, int(b - a)))
                    windows.setdefault(n, []).append((own, np.full(len(own), item)))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, dtype=np.uint64)
        self.windows = {}
        for n, parts in windows.items():
            keys, items = np.concatenate([k for k, _ in parts]), np.concatenate([i for _, i in parts])
            order = np.argsort(keys, kind="stable")
            self.windows[n] = keys[order], items[order]

    def _at(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into keys, item) for every key that is a window of n words."""
        have, items = self.windows[n]
        lo, hi = np.searchsorted(have, keys), np.searchsorted(have, keys, side="right")
        count = hi - lo
        which = np.repeat(np.arange(len(keys)), count)
        return which, items[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]

    def leaks(self, data: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        words, first = _words(data, offs)
        rows = len(first) - 1
        step = np.zeros(len(words) + 1, dtype=np.int64)
        pairs = []

        def hit(n: int, starts: np.ndarray, keys: np.ndarray) -> None:
            which, items = self._at(n, keys)
            begun = starts[np.unique(which)]
            np.add.at(step, begun, 1)
            np.add.at(step, begun + n, -1)
            pairs.append(np.stack((np.searchsorted(first, starts[which], side="right") - 1, items), axis=1))

        if SPAN in self.windows:
            at, marks, row = _fingerprints(words, first)
            found = self.marks[np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)] == marks if len(self.marks) else np.zeros(len(marks), dtype=bool)
            at, row = at[found], row[found]
            around = at[:, None] + np.arange(GRAM - SPAN, 1)
            inside = (around >= first[:-1][row][:, None]) & (around + SPAN <= first[1:][row][:, None])
            starts = np.unique(around[inside])
            sums = np.zeros(len(starts), dtype=np.uint64)
            for i in range(SPAN):
                sums += words[starts + i] * kernel._STEP[i]
            hit(SPAN, starts, kernel.mix(sums))
        for n in self.windows:
            if n < SPAN:  # an item shorter than the guarantee: each of the texts' windows of its length
                keys, begin = kernel.gram_hashes(words, first, n)
                row = np.repeat(np.arange(rows), np.diff(begin))
                full = np.diff(first)[row] >= n
                hit(n, (first[:-1][row] + np.arange(len(keys)) - begin[:-1][row])[full], keys[full])

        covered = np.cumsum(step)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        n_hit = np.diff(total[first])
        ids: list[list[str]] = [[] for _ in range(rows)]
        if pairs and len(both := np.unique(np.concatenate(pairs), axis=0)):
            for r, i in both:
                ids[r].append(self.ids[i])
        spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        for r in np.flatnonzero(n_hit):
            own = np.flatnonzero(np.diff(np.concatenate(([0], covered[first[r] : first[r + 1]].astype(np.int8), [0]))))
            spans[r] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(own[::2], own[1::2], strict=True)]
        return {
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "item_ids": pa.array([sorted(set(x)) for x in ids], pa.list_(pa.string())),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        }


def _marks(lengths: list[int] | None):
    """(id, mark) rows: fingerprints, and windows of each of `lengths` words; None: of the row's own length if under SPAN."""

    def run(batches):
        for batch in batches:
            for start, end, data, offs in kernel.slices(batch.column(1)):
                words, first = _words(data, offs)
                _, marks, row = _fingerprints(words, first)
                rows, keys, count = [row], [marks], np.diff(first)
                for n in range(1, SPAN) if lengths is None else lengths:
                    grams, begin = kernel.gram_hashes(words, first, n)
                    owner = np.repeat(np.arange(len(count)), np.diff(begin))
                    wanted = count[owner] == n if lengths is None else count[owner] >= n
                    rows.append(owner[wanted])
                    keys.append(grams[wanted])
                ids = batch.column(0).slice(start, end - start).take(pa.array(np.concatenate(rows)))
                yield pa.record_batch({"id": ids, "mark": pa.array(np.concatenate(keys).astype(np.int64))})

    return run


def _lengths(batches):
    for batch in batches:
        for _, _, data, offs in kernel.slices(batch.column(0)):
            yield pa.record_batch({"n": pa.array(np.minimum(np.diff(_words(data, offs)[1]), SPAN), pa.int32())})


def _one_text(table: pa.Table) -> pa.Table:
    text = table["text"][0:1].combine_chunks()
    index = Index(table["item_id"].to_pylist(), table["item_text"].combine_chunks())
    (_, _, data, offs), = kernel.slices(text)
    return pa.table({"row": table["row"][0:1].combine_chunks()} | index.leaks(data, offs))


def _joined(docs: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """Leaks of texts that share a fingerprint with an item, or a whole item of under SPAN words, by shuffle joins."""
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    short = [r.n for r in items.select("item_text").mapInArrow(_lengths, "n int").distinct().collect() if 0 < r.n < SPAN]
    marks = keyed.select("row", "text").mapInArrow(_marks(short), "id long, mark long").distinct()
    item_marks = items.select("item_id", "item_text").mapInArrow(_marks(None), "id string, mark long").distinct()
    pairs = marks.join(item_marks.select(F.col("id").alias("item_id"), "mark"), "mark").select(F.col("id").alias("row"), "item_id")
    pairs = pairs.distinct().join(items, "item_id")
    texts = keyed.select("row", "text").dropDuplicates(["row"])
    found = pairs.join(texts, "row").groupBy("row").applyInArrow(_one_text, f"row long, {_LEAKS}")
    counts = keyed.mapInArrow(lambda b: _plain_counts(b), f"doc_id {kind}, row long, n_words long")
    return counts.join(found.drop("n_words"), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans")
    )


def _plain_counts(batches):
    for batch in batches:
        for first, end, data, offs in kernel.slices(batch["text"]):
            own = batch.slice(first, end - first)
            yield pa.record_batch({"doc_id": own["doc_id"], "row": own["row"], "n_words": pa.array(np.diff(_words(data, offs)[1]), pa.int64())})


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, spans for each document.

    Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] with A-Z lower-cased.  An
    item's windows are its runs of 10 words, or all its words if it has fewer.
    n_hit counts document words inside any occurrence of a window, spans lists
    them as word positions, item_ids are the items that occur, sorted as strings.

    Winnowing keeps the least 5-gram hash of every 6, so a shared window always
    shares one; around each shared fingerprint the windows are compared.  Items
    of under 10 words have no fingerprint and are looked up at every position.
    The benchmark's size is measured first: up to broadcast_bytes of text its
    index is broadcast, beyond that fingerprints are joined by shuffles.

    Null or empty texts have no words and no hits; items without id or words
    never occur; items of one id count once.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kernel.small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("item_text")).where("item_id is not null and item_text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    if (items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) > broadcast_bytes:
        return _joined(docs, items, kind)
    table = items.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Index(table["item_id"].to_pylist(), table["item_text"].combine_chunks()))

    def run(batches):
        index = shared.value
        for batch in batches:
            for first, end, data, offs in kernel.slices(batch.column(1)):
                yield pa.record_batch({"doc_id": batch.column(0).slice(first, end - first)} | index.leaks(data, offs))

    return docs.mapInArrow(run, f"doc_id {kind}, {_LEAKS}")
