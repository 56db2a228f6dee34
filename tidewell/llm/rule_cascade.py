"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a repetition window.
WINDOW = 8
#: One document in so many is tried to order the rules.
SAMPLED = 64
#: The measures of every text, in the order of the result.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))


class Texts:
    """A slice of texts; each measure is made once, when a rule first asks for it.

    work counts the bytes that measures have passed over, again for each pass.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.rows = data, offs, len(offs) - 1
        self.known: dict[str, np.ndarray] = {}
        self.work = 0

    def only(self, rows: np.ndarray) -> Texts:
        """The texts of some rows, with what is known of them; bytes are copied when a new measure needs them."""
        return _Some(self, rows)

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in _MEASURES:
            raise AttributeError(name)
        if name not in self.known:
            passes, make = _MEASURES[name]
            self.work += passes * len(self.data)
            self.known |= make(self)
        return self.known[name]

    def count(self, mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.offs])

    @cached_property
    def spans(self):
        return kernel.word_spans(self.data, self.offs, kernel.NON_SPACE)


class _Some(Texts):
    def __init__(self, whole: Texts, at: np.ndarray):
        self.whole, self.at, self.rows = whole, at, len(at)
        self.known = {name: value[at] for name, value in whole.known.items()}
        self.work = 0

    @cached_property
    def offs(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.diff(self.whole.offs)[self.at]))).astype(np.int64)

    @cached_property
    def data(self) -> np.ndarray:
        keep = np.zeros(self.whole.rows, dtype=bool)
        keep[self.at] = True
        return self.whole.data[np.repeat(keep, np.diff(self.whole.offs))]


def _lines(t: Texts) -> dict[str, np.ndarray]:
    """n_lines: lines with a word; n_dup_lines: those among them that equal an earlier line of their text."""
    breaks = np.flatnonzero(t.data == 10)
    starts = np.sort(np.concatenate((t.offs[:-1][np.diff(t.offs) > 0], breaks + 1)))
    row = np.searchsorted(t.offs, starts, side="right") - 1
    inside = (starts < len(t.data)) & (row < t.rows)
    starts, row = starts[inside], row[inside]
    keep = np.concatenate((starts[1:] != starts[:-1], [True])) if len(starts) else np.zeros(0, dtype=bool)
    starts, row = starts[keep], row[keep]
    after = np.searchsorted(breaks, starts)
    ends = np.minimum(np.concatenate((breaks, [len(t.data)]))[after], t.offs[row + 1])
    filled = np.zeros(len(t.data) + 1, dtype=np.int64)
    np.cumsum(kernel.NON_SPACE[t.data], out=filled[1:])
    worded = filled[ends] > filled[starts]
    starts, ends, row = starts[worded], ends[worded], row[worded]
    key = kernel.mix(kernel.span_hashes(t.data, starts, ends) + row.astype(np.uint64) * kernel._STEP[59])
    _, fresh = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[fresh] = False
    return {"n_lines": np.bincount(row, minlength=t.rows), "n_dup_lines": np.bincount(row[again], minlength=t.rows)}


def _repeated(t: Texts) -> np.ndarray:
    starts, ends, first = t.spans
    grams, begin = kernel.gram_hashes(kernel.span_hashes(t.data, starts, ends), first, WINDOW)
    row = np.repeat(np.arange(t.rows), np.diff(begin))
    order = np.argsort(key := kernel.mix(grams + row.astype(np.uint64) * kernel._STEP[59]))
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = first[:-1][row[twice]] + np.flatnonzero(twice) - begin[:-1][row[twice]]
    step = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(step)[:-1] > 0)))
    return np.diff(covered[first])


#: Measure: passes over the bytes, and how it is made.
_MEASURES: dict[str, tuple[int, Callable[[Texts], dict[str, np.ndarray]]]] = {
    "n_words": (2, lambda t: {"n_words": np.diff(t.spans[2]).astype(np.int64)}),
    "word_chars": (2, lambda t: {"word_chars": t.count(kernel.CODE_POINT[t.data] & kernel.NON_SPACE[t.data])}),
    "n_symbols": (1, lambda t: {"n_symbols": t.count(_SYMBOL[t.data])}),
    "n_upper": (1, lambda t: {"n_upper": t.count(_UPPER[t.data])}),
    "n_letters": (1, lambda t: {"n_letters": t.count(_LETTER[t.data])}),
    "n_lines": (4, _lines),
    "n_dup_lines": (4, _lines),
    "n_repeat_words": (6, lambda t: {"n_repeat_words": _repeated(t)}),
}


@dataclass(frozen=True)
class Rule:
    """rejects(texts) is true where a text fails the rule."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _symbols(t: Texts) -> np.ndarray:
    return 10 * t.n_symbols > t.n_words


def _word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 12 * t.n_words)


def _shouting(t: Texts) -> np.ndarray:
    return 100 * t.n_upper > 60 * t.n_letters


def _same_lines(t: Texts) -> np.ndarray:
    return 100 * t.n_dup_lines > 50 * t.n_lines


#: Symbols above a tenth of the words; mean word length outside 2..12; over 60% capitals; over half of the lines repeated.
RULES = (Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("shouting", _shouting), Rule("same_lines", _same_lines))


def base_failed(t: Texts) -> np.ndarray:
    """Under 20 words, or over 30% of them in repeated windows."""
    return (t.n_words < 20) | (100 * t.n_repeat_words > 30 * t.n_words)


def _tried(rules: Sequence[Rule]):
    """(rule, rejected, rows, work): what each rule, alone, does to the texts that pass the base."""

    def run(batches):
        sums = np.zeros((len(rules), 3), dtype=np.int64)
        for batch in batches:
            for _, _, data, offs in kernel.slices(batch.column(0)):
                whole = Texts(data, offs)
                alive = np.flatnonzero(~base_failed(whole))
                for name in BASE:  # the output needs them anyway, so no rule pays for them
                    getattr(whole, name)
                for at, rule in enumerate(rules):
                    left = whole.only(alive)
                    sums[at] += (int(rule.rejects(left).sum()), left.rows, left.work + left.rows)
        yield pa.record_batch({"rule": pa.array(np.arange(len(rules)), pa.int32()), "rejected": pa.array(sums[:, 0]), "rows": pa.array(sums[:, 1]), "work": pa.array(sums[:, 2])})

    return run


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules by share rejected per byte of work on one document in SAMPLED that passes the base, best first.

    docs has doc_id and text.  The sample is a hash of both and is evaluated in
    tasks; work is counted, not timed, so reruns agree.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLED)) == 0).select("text")
    tried = sample.mapInArrow(_tried(rules), "rule int, rejected long, rows long, work long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("rejected", "rows", "work")))
    worth = {r.rule: (r.rejected + 0.5) / (r.rows + 1) / ((r.work + 1) / (r.rows + 1)) for r in tried.collect()}  # a row per rule
    return [rules[at] for at in sorted(range(len(rules)), key=lambda at: (-worth.get(at, 0), at))]


def rule_cascade(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: doc_id, the base measures, base_failed, failed_rule, kept.

    Base measures: n_words (runs of [^\\x20\\x09-\\x0D]), word_chars (their code
    points), n_symbols, n_dup_lines (lines with a word that equal an earlier one),
    n_repeat_words (words in 8-word windows that occur twice or more).  Texts
    that pass the base go through the rules in the order that order_rules finds;
    a text leaves at the first rule that rejects it, and later rules read
    neither it nor its bytes.  What the base has measured is not measured again.
    The order changes cost and failed_rule only: kept is the same for any order.

    A null or empty text has zero words and so fails the base.  Ids may be null
    or repeat; rows stay apart.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kernel.small_batches(docs.sparkSession)
    ordered = order_rules(docs, rules)

    def run(batches):
        for batch in batches:
            for first, end, data, offs in kernel.slices(batch.column(1)):
                texts = Texts(data, offs)
                failed = base_failed(texts)
                counts = {name: pa.array(getattr(texts, name), pa.int64()) for name in BASE}
                rejected_by = np.full(texts.rows, -1)
                alive = np.flatnonzero(~failed)
                left = texts.only(alive)
                for at, rule in enumerate(ordered):
                    if not len(alive):
                        break
                    out = rule.rejects(left)
                    rejected_by[alive[out]] = at
                    if out.any():
                        alive, left = alive[~out], left.only(np.flatnonzero(~out))
                names = ["base" if f else ordered[r].name if r >= 0 else None for f, r in zip(failed, rejected_by, strict=True)]
                yield pa.record_batch(
                    {"doc_id": batch.column(0).slice(first, end - first)} | counts | {"base_failed": pa.array(failed), "failed_rule": pa.array(names, pa.string()), "kept": pa.array(~failed & (rejected_by < 0))}
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, failed_rule string, kept boolean"
    return docs.mapInArrow(run, schema)
