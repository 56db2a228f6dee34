"""Spelling variants: edits of words probed against Bloom filters, then joined to the vocabulary."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .durable import durable

#: Bits of filter a word has on average, and how many of the 64 of its block it sets.
BITS, SET = 16, 4
#: Bytes of filter that one pass broadcasts; a larger vocabulary takes more passes.
FILTER_BYTES = 16 << 20
#: Words of this length and more share a filter.
LONGEST = 64
#: Edits that are probed at once.
BLOCK = 1 << 18

_LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]  # a-z and the Latin-1 letters; A-Z are lower-cased
_CODE = np.full(0x100, 255, dtype=np.uint8)
_CODE[_LETTERS] = np.arange(len(_LETTERS))
_WORD = np.zeros(256, dtype=bool)
_WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0xC3] = True
_RNG = np.random.Generator(np.random.PCG64(0x0B1003))
_VALUE = _RNG.integers(1, 2**63, len(_LETTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_CRC = np.arange(256, dtype=np.uint32)  # the table of CRC-32 by its rule: eight steps of the polynomial for each byte
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _word_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes after those that gave `begun`."""
    order = np.argsort(-sizes, kind="stable")
    at, state = starts[order], begun[order] ^ np.uint32(0xFFFFFFFF)
    alive = len(sizes) - np.searchsorted(sizes[order][::-1], np.arange(int(sizes.max(initial=0))), side="right")
    for i, n in enumerate(alive):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + i]) & 0xFF] ^ state[:n] >> 8
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _no_letter_begins(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    return (here < 0x80) & ~_WORD[here]


def _words_of(least: int, typo_every: int | None):
    """(word, n) of each slice of the texts of (id, text) rows."""

    def run(batches):
        for batch in batches:
            ids = [(x or "").encode() + b":" for x in batch.column(0).to_pylist()]
            for first, end, data, offs in kernel.runs(batch.column(1), _no_letter_begins):
                data = kernel.LOWER[data]
                inside = _WORD[data]
                inside[1:] |= data[:-1] == 0xC3
                starts, ends, head = kernel.mask_spans(inside, offs)
                points = np.concatenate(([0], np.cumsum(kernel.CODE_POINT[data])))
                keep = points[ends] - points[starts] >= least
                typed: list[str] = []
                if typo_every:
                    begun = np.repeat(np.array([zlib.crc32(x) for x in ids[first:end]], dtype=np.uint32), np.diff(head))
                    crc = _word_crcs(data, starts, ends - starts, begun)
                    for w in np.flatnonzero(crc % np.uint32(typo_every) == 0):
                        word = data[starts[w] : ends[w]].tobytes().decode()
                        at = int(crc[w]) % len(word)
                        if len(word) > least:
                            typed.append(word[:at] + word[at + 1 :])
                        keep[w] = False
                starts, sizes = starts[keep], (ends - starts)[keep]
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[kernel.spread(starts, sizes)]))
                counted = pc.value_counts(pa.concat_arrays([words, pa.array(typed, pa.string())]))
                yield pa.record_batch({"word": counted.field(0), "n": counted.field(1)})

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_points: int = 6, least_n: int = 5, typo_every: int | None = None) -> DataFrame:
    """word, n: the words of all whole texts that have least_points code points and occur least_n times.

    A word is a maximal run of [A-Za-z\\u00C0-\\u00FF], with only A-Z lower-cased.
    With typo_every, a word whose CRC-32 of `<id>:<word>` it divides loses the
    code point at CRC modulo length (a null id counts as empty): misspellings
    for a test of what finds them.  Null texts have no words; rows that repeat
    count each time; other columns are ignored.  Words are counted by slice and
    by task before they are shuffled, so a frequent word is a row per task.
    """
    kernel.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_words_of(least_points, typo_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class _Places:
    """The blocks of 64 bits that each length's words have in one row of blocks."""

    def __init__(self, counts: dict[int, int], bits: int):
        self.size = np.zeros(LONGEST + 1, dtype=np.int64)
        for length, n in counts.items():
            self.size[length] = -(-n * bits // 64)
        self.start = np.cumsum(self.size) - self.size
        self.total = int(self.size.sum())

    def block(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """The block of each hash of words of one length."""
        size = self.size[min(length, LONGEST)]
        return self.start[min(length, LONGEST)] + ((hashes >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """The SET bits of each hash within its block."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for i in range(SET):
        out |= np.uint64(1) << (hashes >> np.uint64(6 * i) & np.uint64(63))
    return out


def _matrices(words: pa.Array):
    """(row numbers, letter codes) of the words of each length, in blocks."""
    lengths = pc.utf8_length(words).to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for own in np.array_split(rows, -(-len(rows) * int(length) * len(_LETTERS) // BLOCK)):
            text = "".join(words.take(pa.array(own)).to_pylist())
            yield own, _CODE[np.frombuffer(text.encode("utf-32-le"), np.uint32)].reshape(len(own), int(length))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _filter_rows(places: _Places):
    def run(batches):
        for batch in batches:
            for _, codes in _matrices(batch.column(0)):
                hashes = kernel.mix((_VALUE[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64))
                yield pa.record_batch({"block": pa.array(places.block(hashes, codes.shape[1])), "bits": pa.array(_bits(hashes).view(np.int64))})

    return run


def _edits(codes: np.ndarray):
    """(length, row, position, letter, hash) of edits: each distinct deletion, and each replacement by a later letter.

    An edit's hash follows from the word's own sums; no edit is spelled out.
    The other direction of a pair, an insertion or an earlier letter, is found
    from the other word.
    """
    rows, length = codes.shape
    power = _powers(length)
    terms = _VALUE[codes] * power
    sums = np.zeros((rows, length + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=sums[:, 1:])
    whole = sums[:, -1:]
    if length > 1:
        fresh = np.ones(codes.shape, dtype=bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(fresh)
        yield length - 1, row, at, np.full(len(row), 255, dtype=np.uint8), kernel.mix((sums[:, :-1] + (whole - sums[:, 1:]) * _BACK)[fresh])
    step = max(1, BLOCK // (rows * len(_LETTERS)))
    for a in range(0, length, step):  # a run of positions at a time: a long word has many edits
        row, at, letter = np.nonzero(codes[:, a : a + step, None] < np.arange(len(_LETTERS), dtype=np.uint8))
        at += a
        yield length, row, at, letter.astype(np.uint8), kernel.mix(whole[row, 0] - terms[row, at] + _VALUE[letter] * power[at])


def _positives(places: _Places, shared, lowest: int):
    """(word, n, near) for the edits of (word, n) rows that the filter's blocks from `lowest` hold."""

    def run(batches):
        blocks = shared.value
        for batch in batches:
            words, n = batch.column(0), batch.column(1)
            for own, codes in _matrices(words):
                texts: list[str] = words.take(pa.array(own)).to_pylist()
                found_row, found = [], []
                for length, row, at, letter, hashes in _edits(codes):
                    if not places.size[min(length, LONGEST)]:
                        continue
                    block = places.block(hashes, length) - lowest
                    here = np.flatnonzero((block >= 0) & (block < len(blocks)))
                    bits = _bits(hashes[here])
                    here = here[blocks[block[here]] & bits == bits]
                    for r, i, c in zip(row[here].tolist(), at[here].tolist(), letter[here].tolist(), strict=True):
                        found_row.append(own[r])
                        found.append(texts[r][:i] + ("" if c == 255 else chr(_LETTERS[c])) + texts[r][i + 1 :])
                which = pa.array(found_row, pa.int64())
                yield pa.record_batch({"word": words.take(which), "n": n.take(which), "near": pa.array(found, pa.string())})

    return run


def near_words(words: DataFrame, *, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, near, near_n: all pairs of (word, n) rows that are one edit apart, in both directions.

    words holds distinct words of count_words' letters.  Each length has a
    blocked Bloom filter; filter_bytes of them are broadcast in a pass, so the
    broadcast doesn't grow with the vocabulary: more words take more passes.  Of
    the edits only those that the filter holds are spelled out and joined to
    the words, which leaves exactly the real ones.
    """
    spark = words.sparkSession
    size = F.least(F.char_length("word"), F.lit(LONGEST)).alias("size")
    places = _Places({r["size"]: r["n"] for r in words.groupBy(size).agg(F.count("*").alias("n")).collect()}, BITS)
    blocks = words.select("word").mapInArrow(_filter_rows(places), "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    per_pass = max(1, filter_bytes // 8)
    blocks = durable(blocks) if places.total > per_pass else blocks
    rows = words.select("word", "n")
    parts = rows.sparkSession.createDataFrame([], "word string, n long, near string")
    for lowest in range(0, places.total, per_pass):
        own = blocks.where(F.col("block").between(lowest, lowest + per_pass - 1)).toArrow()
        dense = np.zeros(min(per_pass, places.total - lowest), dtype=np.uint64)
        dense[own["block"].to_numpy() - lowest] = own["bits"].to_numpy().view(np.uint64)
        found = rows.mapInArrow(_positives(places, spark.sparkContext.broadcast(dense), lowest), "word string, n long, near string")
        parts = parts.unionByName(durable(found) if places.total > per_pass else found)
    real = parts.join(rows.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return real.select(F.inline(both))


def group_spellings(words: DataFrame, *, ratio: int = 5, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of the (word, n) rows.

    Words are near if one inserted, deleted or replaced code point tells them
    apart.  A word's form is its near word of largest n, the smallest in
    code-point order of several, if that n is at least ratio times the word's;
    else null.  root follows the forms to the last.  A form occurs more often
    than its word, so forms make trees: they are walked from their tops, a
    round of joins by depth, and a word is the form of no more words than it
    has neighbours.  No words give no rows.
    """
    words = durable(words)
    near = near_words(words, filter_bytes=filter_bytes)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.form"))
    base = words.join(best, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    base = durable(base)
    follow = base.where("form is not null").select("word", "form")
    level = base.where("form is null").select("word", F.col("word").alias("root"))
    roots = level
    while True:
        level = durable(follow.join(level.withColumnRenamed("word", "form"), "form").select("word", "root"))
        if level.isEmpty():
            break
        roots = roots.unionByName(level)
    return base.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")
