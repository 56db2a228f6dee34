"""Line dedup by content-defined chunks, with DataFrame and SQL functions only.

A rolling hash over line hashes, h = 2 h + line, ends a chunk wherever its low
two bits aren't zero; those bits see two lines, so a passage is cut alike
wherever it stands.  Chunks found more than once are joined to their first
occurrence by digest, grown by the equal lines around them and merged to runs;
a run's bytes are compared to those of the first occurrence, then it goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import bounded, durable, held
from .ids import row_key

#: Lines of so many characters are chunks of their own; a run of one line must have as many to be removed.
LONG_LINE = 200
#: Lines before and after a repeated chunk that are compared to those of its first occurrence.
REACH = 4
#: Documents up to which a table of a row per document is broadcast.
BROADCAST_DOCS = 100_000

_ENDS = f"""filter(sequence(1, size(lines)), i -> i = size(lines)
    or length(lines[i - 1]) >= {LONG_LINE} or coalesce(length(get(lines, i)) >= {LONG_LINE}, false)
    or (turns[i - 1] + 2 * coalesce(get(turns, i - 2), 0)) % 4 <> 0)"""
_CHUNKS = """filter(transform(ends, (e, k) -> named_struct('first', if(k = 0, 1, get(ends, k - 1) + 1), 'n', e - if(k = 0, 0, get(ends, k - 1)))),
    c -> exists(slice(lines, c.first, c.n), x -> trim(x) <> ''))"""
_DIGEST = "xxhash64(slice(lines, c.first, c.n))"
_AROUND = f"""reverse(slice(hashes, greatest(c.first - {REACH}, 1), least({REACH}, c.first - 1))) as before,
    slice(hashes, c.first + c.n, {REACH}) as after"""


def _chunked(rows: DataFrame) -> DataFrame:
    """Adds lines and chunks (first, n), those that aren't blank."""
    rows = held(rows, "lines", F.split("text", "\n", -1))
    rows = held(rows, "turns", F.expr("transform(lines, x -> ascii(md5(x)) % 4)"))
    rows = held(rows, "ends", F.expr(_ENDS))
    return held(rows, "chunks", F.expr(_CHUNKS)).drop("turns", "ends")


def _alike(a: str, b: str) -> Column:
    """How many elements of two arrays are equal from the start."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("int")


def _islands(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """Ranges lo..hi that touch or overlap, merged by keys; ties are one range."""
    rows = rows.groupBy(*keys, "lo", "hi").agg(*(sums or (F.lit(1).alias("one"),)))
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(F.col("lo") > F.coalesce(reached, F.lit(-1)) + 1, 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *sums).drop("island")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """doc_key, lo, hi, of_key, of_lo: runs of lines by hash, and where each stands first; rows has doc_key, doc_id, text."""
    chunked = _chunked(rows)
    digests = chunked.select(F.explode(F.expr(f"transform(chunks, c -> {_DIGEST})")).alias("digest"))
    again = durable(digests.groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest"))
    hashed = held(chunked, "hashes", F.expr("transform(lines, x -> xxhash64(x))"))
    found = f"transform(chunks, c -> struct(c.first, c.n, {_DIGEST} as digest, length(array_join(slice(lines, c.first, c.n), '\n')) as chars, {_AROUND}))"
    each = hashed.select("doc_key", "doc_id", F.explode(F.expr(found)).alias("c")).select("doc_key", "doc_id", "c.*")
    each = durable(each.join(again, "digest", "left_semi"))
    place = F.struct("doc_id", "doc_key", "first")
    origin = F.struct(F.col("doc_key").alias("of_key"), F.col("first").alias("of_first"), F.col("before").alias("of_before"), F.col("after").alias("of_after"))
    origins = durable(each.groupBy("digest").agg(F.min_by(origin, place).alias("o")).select("digest", "o.*"))
    pairs = each.join(origins, "digest").where(~((F.col("doc_key") == F.col("of_key")) & (F.col("first") == F.col("of_first"))))
    grown = pairs.select(
        "doc_key",
        "of_key",
        (F.col("first") - F.col("of_first")).alias("shift"),
        (F.col("first") - _alike("before", "of_before")).alias("lo"),
        (F.col("first") + F.col("n") - 1 + _alike("after", "of_after")).alias("hi"),
        "chars",
    )
    runs = _islands(grown, ["doc_key", "of_key", "shift"], F.max("chars").alias("chars")).where(f"hi > lo or chars >= {LONG_LINE}")
    return runs.select("doc_key", "lo", "hi", "of_key", (F.col("lo") - F.col("shift")).alias("of_lo"))


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: Sequence[str] = ()) -> DataFrame:
    """doc_key, doc_id, text (what is left of it), n_lines, n_removed for each document.

    Lines are split at \\n and cut into chunks.  Of each chunk that occurs again
    in any document the first occurrence (by id, then position) stays.  Another
    one grows by the lines before and after it, up to REACH each way, that equal
    those around the first; what touches with the same first document and shift
    is one run.  A run of two lines or more that aren't blank, or of LONG_LINE
    characters or more, that is byte for byte the same is removed, also within
    its own document.  n_removed counts lines.  A removed line always has an
    equal earlier one, so the first of all equal passages stays whole.

    A null text stays null with zero lines, an empty one has one empty line.
    A null id sorts first.  Rows equal in id and text are one document: each
    keeps what the document keeps.  doc_key hashes id and text, for joins.
    The columns in `keep` pass through as the struct `kept`, so their names clash
    with nothing; others are ignored; an empty table gives no rows.
    """
    every = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    every = every.select(row_key("doc_id", "text").alias("doc_key"), *every.columns)
    carry = ["kept"] if keep else []
    rows = every.select("doc_key", "doc_id", "text").where("text is not null")
    runs = durable(repeated_runs(rows).distinct())

    asks = runs.unionByName(runs.select(F.col("of_key").alias("doc_key"), F.col("of_lo").alias("lo"), (F.col("of_lo") + F.col("hi") - F.col("lo")).alias("hi"), "of_key", "of_lo").distinct())
    asks = bounded(asks.groupBy("doc_key").agg(F.collect_list(F.struct("lo", "hi", "of_key", "of_lo")).alias("asks")), BROADCAST_DOCS)
    near = held(rows.join(asks, "doc_key"), "lines", F.split("text", "\n", -1))
    part = "slice(lines, a.lo, a.hi - a.lo + 1)"
    bodies = near.select("doc_key", F.explode(F.expr(f"transform(asks, a -> struct(a.lo, a.hi, a.of_key, a.of_lo, array_join({part}, '\n') as body, size(filter({part}, x -> trim(x) <> '')) as full))")).alias("a")).select("doc_key", "a.*")
    first = (F.col("doc_key") == F.col("of_key")) & (F.col("lo") == F.col("of_lo"))
    originals = bodies.where(first).select("of_key", "of_lo", (F.col("hi") - F.col("lo")).alias("more"), F.col("body").alias("of_body")).dropDuplicates(["of_key", "of_lo", "more"])
    worthy = bodies.where(~first).where(f"full > 1 or length(body) >= {LONG_LINE}").withColumn("more", F.col("hi") - F.col("lo"))
    gone = worthy.join(originals, ["of_key", "of_lo", "more"]).where("body = of_body").select("doc_key", "lo", "hi")
    gone = _islands(gone, ["doc_key"]).groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n_removed"))

    out = every.join(bounded(gone, BROADCAST_DOCS), "doc_key", "left")
    cut, whole = held(out.where("gone is not null"), "lines", F.split("text", "\n", -1)), out.where("gone is null")
    pieces = """flatten(transform(sequence(0, size(gone)), i -> slice(lines, if(i = 0, 1, get(gone, i - 1).hi + 1),
        coalesce(get(gone, i).lo - 1, size(lines)) - if(i = 0, 0, get(gone, i - 1).hi))))"""
    cut = cut.select("doc_key", "doc_id", *carry, F.array_join(F.expr(pieces), "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return cut.unionByName(whole.select("doc_key", "doc_id", *carry, "text", n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")))
