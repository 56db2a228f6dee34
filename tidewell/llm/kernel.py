"""Vectorised word, hash and signature kernels over Arrow string buffers.

Every function works on one bounded slice of a record batch inside a task.
Texts are read as UTF-8 bytes straight from the Arrow buffers; no Python
string is made per word.  Hashes are 64 bit: a polynomial over a random byte
table, finished by an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that one kernel call takes at most, unless one text is longer.
SLICE_BYTES = 1 << 20

#: Rows of an Arrow batch at most: whole texts cross to Python, and Spark's usual 10,000 of them are tens of MB.
BATCH_ROWS = 1_000

_RNG = np.random.Generator(np.random.PCG64(0x51ED27))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the class [^\x20\x09-\x0D].
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: The first byte of each code point.
CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS, if they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(f"{base}")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 4 * SLICE_BYTES:  # one very long text: don't hold on to it
            return have
        _powers[f"{base}"] = have
    return have[:n]


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of bounded runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + SLICE_BYTES, side="right")) - 1)
        yield first, end, raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def runs(column: pa.Array | pa.ChunkedArray, may_begin: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As slices, but a text of over twice SLICE_BYTES comes in several runs of about that size.

    A run begins where may_begin(bytes before, bytes here) is true; without such a place the run goes on.
    """
    for first, end, data, offs in slices(column):
        if len(data) <= 2 * SLICE_BYTES:
            yield first, end, data, offs
            continue
        at = 0  # a slice of this size is one text
        while at < len(data):
            to = at + SLICE_BYTES
            while to < len(data):
                places = np.flatnonzero(may_begin(data[to - 1 : to + 4095], data[to : to + 4096]))
                if len(places):
                    to += int(places[0])
                    break
                to += 4096
            yield first, end, data[at:to], np.array([0, min(to, len(data)) - at])
            at = to


def letters(column: pa.Array | pa.ChunkedArray, context: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, lower-cased code points, row offsets, lead) of bounded runs of rows.

    A text of over twice SLICE_BYTES comes in several runs; each but the first
    begins with the last `context` points of the one before, counted by lead.
    """
    for first, end, data, offs in slices(pc.utf8_lower(column.cast(pa.large_string()))):
        if len(data) <= 2 * SLICE_BYTES:
            heads = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(CODE_POINT[data], out=heads[1:])
            yield first, end, _points(data), heads[offs], 0
            continue
        tail, at = np.zeros(0, np.uint32), 0  # a slice of this size is one text
        while at < len(data):
            to = min(at + SLICE_BYTES, len(data))
            while to < len(data) and not CODE_POINT[data[to]]:
                to -= 1
            points = np.concatenate((tail, _points(data[at:to])))
            yield first, end, points, np.array([0, len(points)]), len(tail)
            tail, at = points[-context:] if context else tail, to


def _points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def word_spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word; no word crosses a row."""
    return mask_spans(word[data], offs)


def mask_spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of true, and each row's first run; no run crosses a row."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the spans, one after another."""
    begin = np.cumsum(counts) - counts
    return np.repeat(starts - begin, counts) + np.arange(int(counts.sum()))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_P_INV, len(data) + 1)[starts])


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, and each row's first window.

    A row of fewer than k words, but not none, has its whole sequence as one window.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(count)), n)
    at = first[:-1][row] + (np.arange(begin[-1]) - begin[:-1][row])
    last = len(words) - 1
    out = np.zeros(len(at), dtype=np.uint64)
    short = count[row] < k
    for i in range(k):
        part = words[np.minimum(at + i, last)] * _STEP[i] if len(at) else out
        if short.any():
            part[short & (count[row] <= i)] = 0
        out += part
    if short.any():
        out[short] += _STEP[63] * count[row][short].astype(np.uint64)
    return mix(out), begin


def super_minhash(grams: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, (rows, m) uint32; all ones where a row has no grams.

    Each gram draws a random permutation of the registers, one swap at a time,
    and offers step + fraction to the register that the step names.  A row is
    done once all its registers are filled: later steps can only offer more.
    """
    rows = len(begin) - 1
    none = np.uint32(0xFFFFFFFF)
    sig = np.full(rows * m, none, dtype=np.uint32)
    row = np.repeat(np.arange(rows), np.diff(begin))
    perm = None
    for j in range(m):
        if not len(grams):
            break
        draw = mix(grams + np.uint64(int(_STEP[62]) * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        value = np.uint32(j << 24) | (draw >> np.uint64(40)).astype(np.uint32)
        k = (j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if perm is None:
            register = k
        else:
            at = np.arange(len(grams))
            register = perm[at, k].astype(np.int64)
        slot = row * m + register
        free = sig[slot] >= np.uint32(j << 24)
        np.minimum.at(sig, slot[free], value[free])
        open_rows = (sig.reshape(rows, m) == none).any(axis=1)
        stay = open_rows[row]
        if not stay.any():
            break
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint8), (int(stay.sum()), 1))
        elif not stay.all():
            perm = perm[stay]
        grams, row, k = grams[stay], row[stay], k[stay]
        at = np.arange(len(grams))
        perm[at, k] = perm[:, j]  # what step j took leaves; position j isn't read again
    return sig.reshape(rows, m)
