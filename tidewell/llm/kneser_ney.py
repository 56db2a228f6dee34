"""Quality classifier: interpolated modified Kneser-Ney over characters, by language.

Nothing of the model passes the driver or is broadcast.  Counts of trusted text
are a table sharded by (language, gram); probabilities come from joins of that
table to the totals of its histories.  Documents are dealt into chunks of
bounded text; a chunk's distinct grams are joined to the sharded probabilities
and come back to the chunk, where they are summed by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .durable import bounded, durable
from .ids import with_ids

#: Characters of the longest gram, and bits of a character: four of 16 bits fill a long.
ORDER, BITS = 4, 16
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 16 << 20
#: One trusted text in so many isn't learned from, but sets the threshold.
HELD_OUT = 5
#: Chunks that one row of a gram lists at most.
LISTED = 256

_CODEC = "zstd"


def _grams(points: np.ndarray, begin: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each character but the lead's, and its row.

    Each row begins after ORDER - 1 zeros.  Code points from 65536 up share
    6144 symbols of the private range.
    """
    points = np.where(points > 0xFFFF, 0xE000 + points % 0x1800, points).astype(np.uint64)
    points[points == 0] = 0xFFFF
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    pad = 0 if lead else ORDER - 1
    at = np.arange(len(points)) + pad * (row + 1)
    symbols = np.zeros(len(points) + pad * (len(begin) - 1), dtype=np.uint64)
    symbols[at] = points
    n = max(len(symbols) - ORDER + 1, 0)
    grams = np.zeros(n, dtype=np.uint64)
    for i in range(ORDER):
        grams = grams << np.uint64(BITS) | symbols[i : i + n]
    return grams[at[lead:] - (ORDER - 1)].view(np.int64), row[lead:]


def _coded(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each gram's place among the distinct ones, and those."""
    coded = pa.array(grams).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy()


def _unique(grams: np.ndarray) -> np.ndarray:
    return pc.unique(pa.array(grams)).to_numpy()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, grams = _coded(np.concatenate([g for g, _ in parts]))
    return grams, np.bincount(code, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _counts(batches):
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        which = np.array([names[x] for x in langs])
        for first, end, points, begin, lead in kernel.letters(batch.column(1), ORDER - 1):
            grams, row = _grams(points, begin, lead)
            own = which[first:end][row]
            for lang, i in names.items():
                if (mine := own == i).any():
                    parts = sums.setdefault(lang, [])
                    code, distinct = _coded(grams[mine])
                    parts.append((distinct, np.bincount(code)))
                    if len(parts) > 8:
                        parts[:] = [_merged(parts)]
    for lang, parts in sums.items():
        grams, n = _merged(parts)
        for a in range(0, len(grams), 100_000):
            part = grams[a : a + 100_000]
            yield pa.record_batch({"lang": pa.array([lang] * len(part), pa.string()), "gram": pa.array(part), "n": pa.array(n[a : a + 100_000])})


def _suffix(gram, size: int):
    return gram.bitwiseAND(F.lit((1 << BITS * size) - 1)) if size < ORDER else gram


def fit_kneser_ney(trusted: DataFrame) -> DataFrame:
    """(lang, slot, gram, value) from trusted (lang, text); the model, sharded by language and gram.

    Slot k of 1 to ORDER holds the log of the interpolated probability of the
    last of k characters after the others.  Slot ORDER + k holds, by history of
    k - 1 characters, the log of the weight that it passes to shorter grams.
    An unseen character is slot 1 of gram 0.  Orders below the longest count
    distinct left neighbours.  Each order has three discounts by language, from
    its counts of counts.
    """
    rows = trusted.where("lang is not null and text is not null").select("lang", "text")
    sizes = [rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))]
    sizes[0] = durable(sizes[0])
    for size in range(ORDER - 1, 0, -1):
        sizes.append(sizes[-1].groupBy("lang", _suffix(F.col("gram"), size).alias("gram")).agg(F.count("*").alias("n")))
    table = None
    for size, part in zip(range(ORDER, 0, -1), sizes, strict=True):
        part = part.select("lang", F.lit(size).alias("size"), "gram", "n")
        table = part if table is None else table.unionByName(part)
    table = durable(table.withColumn("h", F.shiftrightunsigned("gram", BITS)))

    seen = table.groupBy("lang", "size").agg(*(F.count_if(F.col("n") == i).alias(f"t{i}") for i in (1, 2, 3, 4)), F.count("*").alias("kinds"))
    y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1))
    cut = [F.least(F.greatest(i - (i + 1) * y * F.col(f"t{i + 1}") / F.greatest(F.col(f"t{i}"), F.lit(1)), F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}") for i in (1, 2, 3)]
    discounts = bounded(seen.select("lang", "size", "kinds", *cut))
    totals = table.groupBy("lang", "size", "h").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count_if(F.col("n") > 2).alias("n3"))
    totals = totals.join(discounts, ["lang", "size"]).withColumn("back", F.expr("(d1 * n1 + d2 * n2 + d3 * n3) / total"))
    totals = durable(totals.select("lang", "size", "h", "total", "back", "kinds", "d1", "d2", "d3"))
    own = F.greatest(F.col("n") - F.expr("case n when 1 then d1 when 2 then d2 else d3 end"), F.lit(0.0)) / F.col("total")
    shares = table.join(totals, ["lang", "size", "h"]).select("lang", "size", "gram", own.alias("own"), "back", "kinds")

    # a seen gram's suffixes are all seen: each is looked up once, and the interpolation is a sum of products
    suffixes = F.array(*(F.struct(F.lit(k).alias("at"), _suffix(F.col("gram"), k).alias("key")) for k in range(1, ORDER + 1)))
    asked = table.select("lang", "size", "gram", F.explode(F.slice(suffixes, F.lit(1), F.col("size"))).alias("x")).select("lang", "size", "gram", "x.*")
    levels = asked.join(shares.select("lang", F.col("size").alias("at"), F.col("gram").alias("key"), "own", "back", "kinds"), ["lang", "at", "key"])
    levels = levels.groupBy("lang", "size", "gram").agg(
        *(F.max(F.when(F.col("at") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, ORDER + 1) for c in ("own", "back")), F.max(F.when(F.col("at") == 1, F.col("kinds"))).alias("kinds")
    )
    p = 1 / (F.col("kinds") + 1.0)
    for k in range(1, ORDER + 1):
        p = F.when(F.col("size") >= k, F.col(f"own{k}") + F.col(f"back{k}") * p).otherwise(p)
    probabilities = levels.select("lang", F.col("size").alias("slot"), "gram", F.log(p).alias("value"))
    weights = totals.select("lang", (F.col("size") + ORDER).alias("slot"), F.col("h").alias("gram"), F.log("back").alias("value"))
    unseen = totals.where("size = 1").select("lang", F.lit(1).alias("slot"), F.lit(0).cast("long").alias("gram"), F.log(F.col("back") / (F.col("kinds") + 1)).alias("value"))
    return durable(probabilities.unionByName(weights).unionByName(unseen))


def _gram_values(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(lang, gram, value) of distinct (lang, gram): the log probability, by the longest seen suffix and the weights before it."""
    slots = [F.struct(F.lit(k).alias("slot"), _suffix(F.col("full"), k).alias("gram")) for k in range(1, ORDER + 1)]
    slots += [F.struct(F.lit(ORDER + k).alias("slot"), F.shiftrightunsigned(_suffix(F.col("full"), k), BITS).alias("gram")) for k in range(2, ORDER + 1)]
    grams = grams.select("lang", F.col("gram").alias("full"))
    asked = grams.select("lang", "full", F.explode(F.array(*slots)).alias("x")).select("lang", "full", "x.*")
    found = asked.join(model, ["lang", "slot", "gram"]).groupBy("lang", "full").agg(*(F.max(F.when(F.col("slot") == k, F.col("value"))).alias(f"v{k}") for k in range(1, 2 * ORDER + 1) if k != ORDER + 1))
    unseen = bounded(model.where("slot = 1 and gram = 0").select("lang", F.col("value").alias("unseen")))
    known = grams.join(unseen, "lang").join(found, ["lang", "full"], "left")
    value = F.coalesce("v1", "unseen")
    for k in range(2, ORDER + 1):
        value = F.coalesce(F.col(f"v{k}"), F.coalesce(F.col(f"v{ORDER + k}"), F.lit(0.0)) + value)
    return known.select("lang", F.col("full").alias("gram"), value.cast("float").alias("value"))


def _packed(batches):
    """The rows with their texts compressed each for itself; that is what is shuffled."""
    codec = pa.Codec(_CODEC, compression_level=1)
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            raw = part["text"].cast(pa.large_binary()).to_pylist()
            packed = [None if x is None else codec.compress(x, asbytes=True) for x in raw]
            columns = {c: part[c] for c in part.schema.names if c != "text"}
            yield pa.record_batch(columns | {"bytes": pa.array([None if x is None else len(x) for x in raw], pa.int64()), "packed": pa.array(packed, pa.binary())})


def _unpacked(table: pa.Table):
    """(first row, texts) of runs of rows of bounded text."""
    codec = pa.Codec(_CODEC)
    sizes, packed = table["bytes"].to_pylist(), table["packed"].to_pylist()
    first = 0
    while first < len(sizes):
        end, held = first, 0
        while end < len(sizes) and (end == first or held + (sizes[end] or 0) <= kernel.SLICE_BYTES):
            held += sizes[end] or 0
            end += 1
        yield first, pa.array([b"" if x is None else codec.decompress(x, n, asbytes=True) for x, n in zip(packed[first:end], sizes[first:end], strict=True)], pa.large_binary()).cast(pa.large_string())
        first = end


def _distinct(table: pa.Table) -> pa.Table:
    """(chunk, lang, gram): the distinct grams of a chunk."""
    found: dict[str, list[np.ndarray]] = {}
    langs = table["lang"].to_pylist()
    for at, texts in _unpacked(table):
        own = langs[at : at + len(texts)]
        names = {x: i for i, x in enumerate(dict.fromkeys(x for x in own if x is not None))}
        which = np.array([names.get(x, -1) for x in own])
        for first, end, points, begin, lead in kernel.letters(texts, ORDER - 1):
            grams, row = _grams(points, begin, lead)
            of = which[first:end][row]
            for lang, i in names.items():
                if (mine := of == i).any():
                    parts = found.setdefault(lang, [])
                    parts.append(_unique(grams[mine]))
                    if len(parts) > 8:
                        parts[:] = [_unique(np.concatenate(parts))]
    each = {x: _unique(np.concatenate(p)) for x, p in found.items()}
    lang = [pa.array([x] * len(g), pa.string()) for x, g in each.items()]
    gram = [pa.array(g, pa.int64()) for g in each.values()]
    n = sum(map(len, gram))
    chunk = pa.array(np.full(n, table["chunk"][0].as_py(), dtype=np.int64))
    return pa.table({"chunk": chunk, "lang": pa.concat_arrays([pa.array([], pa.string()), *lang]), "gram": pa.concat_arrays([pa.array([], pa.int64()), *gram])})


def _summed(docs: pa.Table, values: pa.Table) -> pa.Table:
    """The chunk's documents with n_grams and perplexity."""
    tables = {}
    of = values["lang"].combine_chunks().dictionary_encode() if len(values) else None
    if of is not None:
        code, gram, value = of.indices.to_numpy(), values["gram"].to_numpy(), values["value"].to_numpy()
        for i, lang in enumerate(of.dictionary.to_pylist()):
            mine = code == i
            order = np.argsort(gram[mine])
            tables[lang] = gram[mine][order], value[mine][order].astype(np.float64)
    langs = docs["lang"].to_pylist()
    total, count = np.zeros(len(langs)), np.zeros(len(langs), dtype=np.int64)
    for at, texts in _unpacked(docs):
        for first, end, points, begin, lead in kernel.letters(texts, ORDER - 1):
            grams, row = _grams(points, begin, lead)
            rows = slice(at + first, at + end)
            count[rows] += np.bincount(row, minlength=end - first)
            own = langs[rows]
            for lang in {x for x in own if x in tables}:
                mine = np.array([x == lang for x in own])[row]
                code, distinct = _coded(grams[mine])
                have, value = tables[lang]
                total[rows] += np.bincount(row[mine], weights=value[np.searchsorted(have, distinct)][code], minlength=end - first)
    scored = (count > 0) & np.array([x in tables for x in langs], dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.exp(-total / count)
    out = {c: docs[c] for c in docs.column_names if c not in ("chunk", "bytes", "packed")}
    return pa.table(out | {"n_grams": pa.array(count), "perplexity": pa.array(np.where(scored, value, 0.0), mask=~scored)})


def score_perplexity(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, held_out, n_grams, perplexity (per character) by the text's own language's model.

    held_out tells whether the text, if trusted, sets thresholds instead of
    being learned from; equal texts agree.  perplexity is null for empty or null
    texts and for languages without a model.  Rows are dealt by a hash of id and
    text into chunks of about CHUNK_BYTES; rows without id or text by position.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    kernel.small_batches(docs.sparkSession)
    chunks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES))
    plain = F.col("doc_id").isNull() | F.coalesce(F.col("text") == "", F.lit(True))
    chunk = F.pmod(F.when(plain, F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", "text")), F.lit(chunks))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select(chunk.alias("chunk"), "doc_id", "lang", held_out(F.col("text")).alias("held_out"), "text")
    dealt = dealt.mapInArrow(_packed, f"chunk long, doc_id {kind}, lang string, held_out boolean, bytes long, packed binary")
    grams = dealt.groupBy("chunk").applyInArrow(_distinct, "chunk long, lang string, gram long")
    # a gram that all chunks hold has a row for each LISTED of them, so no list grows with the corpus
    # (nothing is written here: within one query Spark deals the texts out once, for the grams and for the sums)
    listed = grams.groupBy("lang", "gram", F.floor(F.col("chunk") / LISTED).alias("part")).agg(F.collect_list("chunk").alias("chunks"))
    asked = listed.groupBy("lang", "gram").agg(F.sum(F.size("chunks")).alias("times")).where("times > 0")  # the same lists, so that they are made once
    values = _gram_values(asked, model)
    back = listed.join(values, ["lang", "gram"]).select(F.explode("chunks").alias("chunk"), "lang", "gram", "value")
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_summed, f"doc_id {kind}, lang string, held_out boolean, n_grams long, perplexity double")


def held_out(text):
    """Whether a trusted text is held out of learning."""
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(HELD_OUT)) == 0, F.lit(False))


def classify_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, quantile: float = 0.99) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, threshold, kept for each document.

    The model learns from the documents whose id is in `trusted`, but for one
    text in HELD_OUT (by a hash of the text).  Short texts vary more, so a
    document's score is its language's median perplexity plus its own excess
    over it, divided by 1 + 20 / sqrt(n_grams).  Median and threshold, the
    `quantile` of the scores, come from the trusted texts held out; a document
    whose score is above the threshold is rejected.

    Documents that can't be judged (no text, no language, no trusted text
    learned or held out in the language) are kept with a null perplexity or
    threshold.  Ids may be null, repeat and have any type; other columns are
    ignored; an empty table gives no rows.
    """
    kernel.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    ids = trusted.select(F.col(id_col).alias("doc_id"))
    model = fit_kneser_ney(with_ids(rows.where(~held_out(F.col("text"))), ids))
    scored = durable(score_perplexity(rows, model))
    basis = durable(with_ids(scored.where("held_out and perplexity is not null"), ids))
    medians = bounded(basis.groupBy("lang").agg(F.percentile_approx("perplexity", 0.5, 10_000).alias("median")))
    score = F.col("median") + (F.col("perplexity") - F.col("median")) / (1 + 20 / F.sqrt(F.greatest(F.col("n_grams"), F.lit(1))))
    limits = bounded(basis.join(medians, "lang").groupBy("lang").agg(F.first("median").alias("median"), F.percentile_approx(score, quantile, 10_000).alias("threshold")))
    out = scored.join(limits, "lang", "left")
    return out.select("doc_id", "lang", "n_grams", "perplexity", "threshold", F.coalesce(score <= F.col("threshold"), F.lit(True)).alias("kept"))
