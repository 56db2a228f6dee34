"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: N-gram lengths, hash buckets as a power of two, additive smoothing.
ORDERS, BITS, ALPHA = (1, 2, 3), 15, 0.5
#: Languages that a model may hold; the broadcast matrix has LANGUAGES * 2**BITS cells at most.
LANGUAGES = 256
#: N-grams whose columns of the matrix are gathered at once.
BLOCK = 1 << 16


def _buckets(points: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams in row order, and how many each row has."""
    count = np.maximum(np.diff(begin) - n + 1, 0)
    total = max(len(points) - n + 1, 0)
    mixed = np.full(total, int(kernel._STEP[40 + n]), dtype=np.uint64)
    for i in range(n):
        mixed += points[i : i + total].astype(np.uint64) * kernel._STEP[i]
    inside = np.zeros(total + 1, dtype=np.int32)
    some = count > 0
    np.add.at(inside, begin[:-1][some], 1)
    np.add.at(inside, begin[:-1][some] + count[some], -1)
    inside = np.cumsum(inside[:-1]) > 0
    mixed ^= mixed >> np.uint64(32)
    mixed *= kernel._STEP[50]
    return (mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64), count


def _runs(column: pa.Array):
    """(first row, end row, [(buckets, counts by row) for each order]) of bounded runs; no n-gram comes twice."""
    for first, end, points, begin, lead in kernel.letters(column, max(ORDERS) - 1):
        skips = [max(lead - n + 1, 0) for n in ORDERS]
        yield first, end, [_buckets(points[s:], np.maximum(begin - s, 0), n) for n, s in zip(ORDERS, skips, strict=True)]


def _counted(batches):
    totals: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        for x in names:
            texts[x] = texts.get(x, 0) + 1
        for first, end, runs in _runs(batch.column(1)):
            code = {x: i for i, x in enumerate(dict.fromkeys(names[first:end]))}
            owner = np.array([code[x] for x in names[first:end]])
            sums = np.zeros(len(code) << BITS, dtype=np.int64)
            for bucket, count in runs:
                sums += np.bincount(np.repeat(owner, count) << BITS | bucket, minlength=len(sums))
            for x, i in code.items():
                totals[x] = totals.get(x, 0) + sums[i << BITS : i + 1 << BITS]
    for x, sums in totals.items():
        at = np.flatnonzero(sums)
        n = len(at) + 1
        yield pa.record_batch({"lang": pa.array([x] * n, pa.string()), "bucket": pa.array([-1, *at.tolist()], pa.int32()), "n": pa.array([texts[x], *sums[at].tolist()], pa.int64())})


def fit_language_model(train: DataFrame, lang_col: str = "lang", text_col: str = "text", *, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities of 2**BITS buckets by language) of all rows of train.

    Rows without a language or text are left out.  The counts are summed by
    Spark; at most `languages` * (2**BITS + 1) sums come to the driver, and more
    languages than that raise ValueError.  No rows give a model without languages.
    """
    kernel.small_batches(train.sparkSession)
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(known := rows.select("lang").distinct().limit(languages + 1).collect()) > languages:
        raise ValueError(f"more than {languages} languages")
    langs = sorted(r.lang for r in known)
    table = counts.toArrow()
    which = {x: i for i, x in enumerate(langs)}
    owner = np.array([which[x] for x in table["lang"].to_pylist()], dtype=np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    sums, prior = np.full((len(langs), 1 << BITS), ALPHA), np.zeros(len(langs))
    head = bucket < 0
    prior[owner[head]] = n[head]
    sums[owner[~head], bucket[~head]] += n[~head]
    with np.errstate(divide="ignore"):
        return langs, np.log(prior / max(prior.sum(), 1)), np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each document, from its whole text.

    score is the posterior of lang_pred among the learned languages, 0 to 1.
    A text that is null or has no letter is `und` with score 0, as is every text
    if no language was learned.  Ids may be null or repeat; other columns are ignored.
    """
    kernel.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast((model[1], np.ascontiguousarray(model[2].T)))

    def run(batches):
        prior, table = shared.value
        for batch in batches:
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\pL"), False).to_numpy(zero_copy_only=False)
            score = np.tile(prior, (batch.num_rows, 1)) if langs else np.zeros((batch.num_rows, 1))
            for first, _, runs in _runs(batch.column(1)) if langs else ():
                for bucket, count in runs:
                    row = np.repeat(np.arange(len(count)), count) + first
                    for a in range(0, len(bucket), BLOCK):  # a block of the rows' sparse counts at a time
                        own = row[a : a + BLOCK]
                        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                        score[own[starts]] += np.add.reduceat(table[bucket[a : a + BLOCK]], starts, axis=0, dtype=np.float64)
            best = score.argmax(axis=1)
            share = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
            known = lettered & bool(langs)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "lang_pred": pa.array([langs[i] if k else "und" for i, k in zip(best, known, strict=True)], pa.string()),
                    "score": pa.array(np.where(known, share, 0.0)),
                }
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
