"""Byte-level BPE: vectorised merges over length-bucketed matrices of pieces."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel

#: Tokens that a vocabulary may hold: its tables are broadcast, about 100 bytes a token.
MOST_TOKENS = 1 << 20
#: Cells of a matrix of pieces; bytes of a piece beyond which it is merged by itself.
CELLS, LONG = 1 << 19, 256

_NONE = np.iinfo(np.int32).max
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The endings that the pattern takes as pieces of their own after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class _Table:
    """64-bit keys to 32-bit values by open addressing; looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, dtype=np.uint64)
        self.values = np.full(int(self.mask) + 1, _NONE, dtype=np.int32)
        left, slot = np.arange(len(keys)), kernel.mix(keys) & self.mask
        while len(left):  # the first to come takes a free slot, the others go on
            _, head = np.unique(slot, return_index=True)
            head = head[self.values[slot[head]] == _NONE]
            self.keys[slot[head]], self.values[slot[head]] = keys[left[head]], values[left[head]]
            stay = np.ones(len(left), dtype=bool)
            stay[head] = False
            left, slot = left[stay], (slot[stay] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, _NONE where there is none."""
        slot = kernel.mix(keys) & self.mask
        out = self.values[slot]
        left = np.flatnonzero((self.keys[slot] != keys) & (out != _NONE))
        while len(left):
            slot_left = (slot[left] + np.uint64(1)) & self.mask
            slot[left] = slot_left
            out[left] = self.values[slot_left]
            left = left[(self.keys[slot_left] != keys[left]) & (out[left] != _NONE)]
        return out


def _character_classes() -> np.ndarray:
    """Letter, number, space or other for each code point, as the tiktoken library's own patterns have them."""
    every = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype(np.uint32)
    text = every.tobytes().decode("utf-32-le")
    found = np.full(0x110000, _OTHER, dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        one = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found[np.frombuffer(one.decode_bytes(one.encode_ordinary(text)).decode().encode("utf-32-le"), np.uint32)] = kind
    return found


class Vocabulary:
    """A vocabulary's tables, built from token bytes by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        if len(ranks) > MOST_TOKENS or max(ranks.values(), default=0) >= 2 * MOST_TOKENS:
            raise ValueError(f"more than {MOST_TOKENS} tokens, or ranks of twice that")
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.classes = _character_classes()
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        rank = np.array([*ranks.values()], dtype=np.int64)
        size = np.array([len(t) for t in ranks], dtype=np.int64)
        self.size = np.zeros(int(rank.max()) + 1, dtype=np.int64)
        self.start = np.zeros_like(self.size)
        self.size[rank], self.start[rank] = size, np.cumsum(size) - size
        self.text = np.frombuffer(b"".join(ranks), np.uint8)
        self.whole = _Table(kernel.span_hashes(self.text, self.start[rank], self.start[rank] + size), rank.astype(np.int32))
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, value = (np.array(x, dtype=np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        self.pairs = _Table(_pair_keys(left, right), value.astype(np.int32))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, _NONE where it has none or a side is padding."""
        return self.pairs.find(_pair_keys(left, right))

    def whole_pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The rank of each piece that is a token, _NONE of others."""
        rank = self.whole.find(kernel.span_hashes(data, starts, starts + sizes))
        some = np.flatnonzero(rank != _NONE)
        some_fit = self.size[rank[some]] == sizes[some]
        rank[some[~some_fit]] = _NONE
        some = some[some_fit]
        same = self.text[kernel.spread(self.start[rank[some]], sizes[some])] == data[kernel.spread(starts[some], sizes[some])]
        if not same.all():  # equal hashes of different bytes
            rank[np.repeat(some, sizes[some])[~same]] = _NONE
        return rank


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left.astype(np.int64) + 1) << 32 | (right.astype(np.int64) + 1)).view(np.uint64)


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file: a line per token, its bytes in base64, a space and its rank."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


def piece_starts(points: np.ndarray, begin: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Which code points begin a match of the pattern, for rows that begin at `begin`.

    The pattern's matches tile a text: an ending after an apostrophe; letters,
    numbers or others with one blank before them; white space, of which the last
    character is left to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=bool)
    kind = classes[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[begin] = edge[n] = True
    turn = edge[:-1].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    starts = turn.copy()
    starts[1:] &= ~(~space[1:] & (points[:-1] == 0x20) & ~edge[1:-1])
    starts[:-1] |= space[:-1] & ~space[1:] & ~edge[1:-1]
    marks = np.flatnonzero((points == 0x27) & turn & starts)
    row_end = np.append(begin, n)[np.searchsorted(begin, marks, side="right")]
    for ending in _ENDINGS:
        fits = marks + len(ending) < row_end
        for i, letter in enumerate(ending, 1):
            fits &= points[np.minimum(marks + i, n - 1)] == ord(letter)
        at = marks[fits]
        starts[at + 1] = False
        after = at + 1 + len(ending)
        starts[after[after < n]] = True
    return starts


def _distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one of each of the distinct pieces, and which of them each piece is; pieces tile data."""
    _, first, which = np.unique(kernel.span_hashes(data, starts, starts + sizes), return_index=True, return_inverse=True)
    model = first[which]
    wrong = sizes != sizes[model]
    shared = np.where(wrong, 0, sizes)
    same = data[kernel.spread(starts, shared)] == data[kernel.spread(starts[model], shared)]
    if not same.all():
        wrong[np.repeat(np.arange(len(starts)), shared)[~same]] = True
    odd = np.flatnonzero(wrong)  # another piece has the same hash: they stand for themselves
    which[odd] = len(first) + np.arange(len(odd))
    return np.append(first, odd), which


def _merge_rows(ids: np.ndarray, words: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, ids) of rows as they are done; -1 pads a row's end.

    Each round every row merges its leftmost pair of least rank, so that every
    matrix loses one column; rows that have no pair left are taken out.
    """
    row = np.arange(len(ids))
    rank = words.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
    while len(row):
        at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), dtype=np.int64)
        least = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), _NONE)
        done = least == _NONE
        if done.any():
            yield row[done], ids[done]
            row, ids, rank, at, least = row[~done], ids[~done], rank[~done], at[~done], least[~done]
            if not len(row):
                return
        n, width = ids.shape
        every = np.arange(n)
        ids[every, at] = least
        keep = np.ones((n, width), dtype=bool)
        keep[every, at + 1] = False
        ids = ids[keep].reshape(n, width - 1)
        keep = np.ones((n, width - 1), dtype=bool)
        keep[every, at] = False
        rank = rank[keep].reshape(n, width - 2)
        has = np.flatnonzero(at > 0)
        rank[has, at[has] - 1] = words.rank_of(ids[has, at[has] - 1], least[has])
        has = np.flatnonzero(at < width - 2)
        rank[has, at[has]] = words.rank_of(least[has], ids[has, at[has] + 1])


def _merge_long(ids: np.ndarray, words: Vocabulary) -> np.ndarray:
    """The ids of one long piece.

    A round merges, from the left, all pairs of least rank up to the first whose
    merge makes a pair of a lower rank: those are the pairs that rounds of one
    merge would take, in that order.
    """
    rank = words.rank_of(ids[:-1], ids[1:])
    while len(rank) and (least := rank.min()) != _NONE:
        at = np.flatnonzero(rank == least)
        head = np.concatenate(([True], np.diff(at) > 1))
        at = at[(at - at[head][np.cumsum(head) - 1]) % 2 == 0]  # of pairs that overlap every second
        touch = np.concatenate(([False], np.diff(at) == 2))
        left = np.where(touch, least, np.where(at > 0, ids[at - 1], -1))
        right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
        merged = np.full(len(at), least)
        lower = np.flatnonzero((words.rank_of(left, merged) < least) | (words.rank_of(merged, right) < least))
        if len(lower):
            at = at[: lower[0] + 1]
        ids[at] = least
        ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
        at = at - np.arange(len(at))
        for near in (at[at > 0] - 1, at[at < len(rank)]):
            rank[near] = words.rank_of(ids[near], ids[near + 1])
    return ids


def encode_pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the pieces one after another, and how many each piece has."""
    count = np.ones(len(starts), dtype=np.int64)
    rank = words.whole_pieces(data, starts, sizes)
    open_ = np.flatnonzero(rank == _NONE)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    bucket = np.ceil(np.log2(np.maximum(sizes[open_], 2))).astype(np.int64)
    for b in np.unique(bucket):
        own = open_[bucket == b]
        if 1 << b > LONG:
            for piece in own:
                ids = _merge_long(words.bytes[data[starts[piece] : starts[piece] + sizes[piece]]], words)
                parts.append((np.full(len(ids), piece), ids))
                count[piece] = len(ids)
            continue
        for block in np.array_split(own, max(1, -(-len(own) << b) // CELLS)):
            width = int(sizes[block].max(initial=1))
            inside = np.arange(width) < sizes[block][:, None]
            ids = np.full(inside.shape, -1, dtype=np.int32)
            ids[inside] = words.bytes[data[kernel.spread(starts[block], sizes[block])]]
            for row, done in _merge_rows(ids, words):
                real = done >= 0
                count[block[row]] = real.sum(axis=1)
                parts.append((np.repeat(block[row], real.sum(axis=1)), done[real]))
    begin = np.cumsum(count) - count
    flat = np.empty(int(count.sum()), dtype=np.int32)
    ready = rank != _NONE
    flat[begin[ready]] = rank[ready]
    for owner, ids in parts:  # the ids of an owner stand together
        new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
        flat[kernel.spread(begin[owner[new]], np.diff(np.append(new, len(owner))))] = ids
    return flat, count


def _blank_begins(before: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Where a piece begins whatever surrounds it: a blank or line end after a printable ASCII character."""
    before = before[: len(here)]
    return ((here == 0x20) | (here == 0x0A)) & (before > 0x20) & (before < 0x7F)


def _well_formed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, row offsets and code points; bytes that aren't UTF-8 become U+FFFD."""
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        text = "".join(rows)
        data, offs = np.frombuffer(text.encode(), np.uint8), np.cumsum([0, *(len(r.encode()) for r in rows)])
    return data, offs, np.frombuffer(text.encode("utf-32-le"), np.uint32)


def encode_batch(column: pa.Array, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts, row by row, and how many each row has."""
    total, found = np.zeros(len(column), dtype=np.int64), []
    for first, end, data, offs in kernel.runs(column, _blank_begins):
        if not len(data):
            continue
        data, offs, points = _well_formed(data, offs)
        heads = np.flatnonzero(kernel.CODE_POINT[data])
        begin = np.searchsorted(heads, offs[:-1][np.diff(offs) > 0])
        starts = heads[piece_starts(points, begin, words.classes)]
        sizes = np.diff(np.append(starts, len(data)))
        one, which = _distinct(data, starts, sizes)
        ids, count = encode_pieces(data, starts[one], sizes[one], words)
        own = count[which]
        found.append(ids[kernel.spread((np.cumsum(count) - count)[which], own)])
        upto = np.concatenate(([0], np.cumsum(own)))
        total[first:end] += np.diff(upto[np.searchsorted(starts, offs)])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int32), total


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of bytes, as binary."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _shared(spark: SparkSession, vocabulary: str | Vocabulary):
    return spark.sparkContext.broadcast(load_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)


def encode_texts(docs: DataFrame, vocabulary: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: the token ids of each whole text, as little-endian unsigned 32-bit integers.

    vocabulary is a rank file (a path on the driver) or a Vocabulary; its tables
    are broadcast, MOST_TOKENS tokens at most, or ValueError.  A text is split by
    the pattern of piece_starts.  A piece that is a token becomes it; others start
    as bytes and merge the leftmost adjacent pair of least rank until none is left.
    There are no special tokens: their strings are ordinary text.

    A null or empty text has no tokens.  Texts of any length are encoded in runs
    of about 1 MB, cut before a blank that ends a piece; only a single piece is
    ever held whole.  Ids may be null or repeat; other columns are ignored.
    """
    kernel.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = _shared(docs.sparkSession, vocabulary)

    def run(batches):
        for batch in batches:
            flat, count = encode_batch(batch.column(1), shared.value)
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(count), "ids": _binary(flat.astype("<u4"), 4 * count)})

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str | Vocabulary, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """Adds the bytes that a row's ids stand for, as binary; null ids give none, as do no ids.

    Bytes need not be UTF-8: a run of ids may end inside a character.  An id
    without a token raises ValueError.
    """
    shared = _shared(encoded.sparkSession, vocabulary)
    schema = encoded.drop(to_col).schema.add(to_col, "binary")
    at = schema.fieldNames().index(ids_col)

    def run(batches):
        words = shared.value
        for batch in batches:
            column = batch.column(at).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4").astype(np.int64)
            if len(ids) and (ids.max() >= len(words.size) or not words.size[ids].all()):
                raise ValueError("an id has no token")
            size = words.size[ids]
            upto = np.concatenate(([0], np.cumsum(size)))
            flat = np.empty(int(upto[-1]), dtype=np.uint8)
            for a in range(0, len(ids), CELLS):  # a block of ids at a time
                flat[upto[a] : upto[min(a + CELLS, len(ids))]] = words.text[kernel.spread(words.start[ids[a : a + CELLS]], size[a : a + CELLS])]
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(flat, np.diff(upto[(offsets - offsets[0]) // 4]))], [*batch.schema.names, to_col])

    return encoded.drop(to_col).mapInArrow(run, schema)
