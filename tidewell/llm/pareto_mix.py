"""Mixing sources to target weights: whole copies, then Pareto order sampling of the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: No document is taken more often.
MOST_COPIES = 3
#: Rows of a table of sources up to which it is broadcast.
BROADCAST_SOURCES = 50_000
_CELLS = 4096


def _targets(sized: DataFrame, weights: Sequence[int]) -> DataFrame:
    """source, source_size, target by water-filling; the tables here have a row per source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("cap", MOST_COPIES * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    total, everyone = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    left = total - F.coalesce(F.sum("cap").over(order), F.lit(0))
    open_weight = everyone - F.coalesce(F.sum("weight").over(order), F.lit(0))
    level = ranked.withColumn("level", left / open_weight)
    # capping a source raises the level for those after it, passing one that fits lowers it: the peak is the water line
    line = F.coalesce(F.max("level").over(Window.partitionBy()), F.lit(0.0))
    target = level.withColumn("target", F.least(line * F.col("weight"), F.col("cap").cast("double")))
    return target.select("source", "source_size", "target")


def _crossing(rows: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """By source, the cell in which the sizes summed in rank order pass the rest, and the sum before it."""
    sums = rows.groupBy("source", "start", "rest", *keys, cell).agg(F.sum("size").alias("words"))
    before = F.col("start") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("before", before).where("before < rest and rest <= before + words").select("source", F.col(cell).alias("crossed"), "before")


def _by_source(rows: DataFrame, sources: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """rows with the columns of a table of a row per source; null is a source."""
    sources = sources.withColumnRenamed("source", "_of")
    return rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def _scale(eligible: DataFrame) -> DataFrame:
    """source, scale: the inclusion probabilities least(1, scale * weight) whose sizes sum to the rest.

    Weights whose share would pass 1 are certain and leave; the others are
    scaled anew.  Weights have 8 significant bits, so a source has a few
    thousand levels whatever its rows.
    """
    levels = eligible.groupBy("source", "rest", "weight").agg(F.sum("size").alias("words"), F.sum(F.col("weight").cast("decimal(19,0)") * F.col("size")).alias("mass"))
    order = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    above, passed = F.coalesce(F.sum("words").over(order), F.lit(0)), F.coalesce(F.sum("mass").over(order), F.lit(0).cast("decimal(38,0)"))
    mass = F.sum("mass").over(Window.partitionBy("source")) - passed
    levels = levels.withColumn("scale", (F.col("rest") - above) / mass.cast("double"))
    return levels.where("scale * weight <= 1").groupBy("source").agg(F.max_by("scale", "weight").alias("scale"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    *,
    weights: Sequence[int] = (1, 2, 3),
    seed: str = "mix",
    importance: Column | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each document.

    size counts runs of [^\\x20\\x09-\\x0D] in the text.  Sources by code point,
    null last, weigh `weights` in turn and share all words; a target stops at
    3 times its source's words and the excess is shared anew by weight.

    Each document no longer than its source's target gets as many certain
    copies as fit for all of them, 3 at most.  The rest of the target is a
    sample without replacement of fixed size in words: inclusion probabilities
    are in proportion to `importance` (a whole number, by default the size; 8
    significant bits of it count), documents whose share passes 1 are certain
    and the others' shares are scaled anew.  Documents are ranked by the odds
    of a random number over the odds of their inclusion and taken in this order
    while they fit.  What is still open goes to the one document left whose
    size comes nearest to it, if that helps.  taken = copies * size.

    The random number is a hash of seed and id (of the text where the id is
    null), so reruns agree.  The crossing is found by two histograms of 4096
    cells per source, never by ordering a whole source.  Null or empty texts
    have size 0 and take certain copies only; null is a source of its own; rows
    that repeat an id share its rank; an empty table gives no rows.  Other
    columns are ignored.
    """
    word = r"[^\x20\x09-\x0D]+"
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(word)), F.lit(0)).cast("long").alias("size"), (F.lit(None) if importance is None else importance).cast("long").alias("weight"), F.xxhash64(F.col(text_col)).alias("hash"), F.monotonically_increasing_id().alias("row"))
    sized = durable(sized)
    targets = durable(_targets(sized, weights))
    few = targets.count() <= BROADCAST_SOURCES
    rows = _by_source(sized, targets, few)
    fitting = rows.where("size <= target").groupBy("source", "target").agg(F.sum("size").alias("fits"))
    whole = F.when(F.col("fits") > 0, F.least(F.floor(F.col("target") / F.col("fits")), F.lit(MOST_COPIES))).otherwise(0).cast("long")
    rest = F.greatest(F.col("target") - F.col("whole") * F.col("fits"), F.lit(0.0))
    plans = durable(fitting.withColumn("whole", whole).withColumn("rest", rest).select("source", "whole", "rest"))
    fit = F.col("size") <= F.col("target")
    rows = _by_source(rows, plans, few).withColumn("rest", F.coalesce("rest", F.lit(0.0))).withColumn("whole", F.when(fit, F.coalesce("whole", F.lit(0))).otherwise(0))
    weight = F.greatest(F.coalesce("weight", "size"), F.lit(1))
    low = F.greatest(F.length(F.bin(weight)) - 8, F.lit(0))
    rows = rows.withColumn("weight", weight - F.pmod(weight, F.pow(F.lit(2), low).cast("long")))
    eligible = fit & (F.col("size") > 0) & (F.col("size") <= F.col("rest")) & (F.col("whole") < MOST_COPIES)
    rows = _by_source(rows, durable(_scale(rows.where(eligible))), few)
    chance = F.when(eligible, F.least(F.coalesce("scale", F.lit(1.0)) * F.when(F.col("scale").isNull(), F.lit(1.0)).otherwise(F.col("weight")), F.lit(1.0)))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("hash").cast("string")))
    draw = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), own)), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    odds = (draw / (1 - draw)) / (F.col("chance") / (1 - F.col("chance")))
    rows = rows.withColumn("chance", chance).withColumn("place", F.when(F.col("chance") < 1, odds / (1 + odds)))
    rows = rows.withColumn("cell", F.floor(F.col("place") * _CELLS)).withColumn("fine", F.floor(F.col("place") * _CELLS * _CELLS))
    rows = durable(rows.select("doc_id", "source", "size", "row", "source_size", "target", "whole", "rest", "chance", "place", "cell", "fine"))

    certain = rows.where("chance >= 1").groupBy("source").agg(F.sum("size").alias("start"))
    drawn = _by_source(rows.where("chance < 1"), durable(certain), few).withColumn("start", F.coalesce("start", F.lit(0)))
    first = durable(_crossing(drawn, [], "cell").select("source", F.col("crossed").alias("c1"), F.col("before").alias("c1_before")))
    near = _by_source(drawn, first, few)
    inner = near.where("cell = c1").withColumn("start", F.col("c1_before"))
    second = durable(_crossing(inner, ["c1"], "fine").select("source", F.col("crossed").alias("c2"), F.col("before").alias("c2_before")))
    near = _by_source(near, second, few)
    at_edge = F.coalesce((F.col("cell") == F.col("c1")) & (F.col("fine") == F.col("c2")), F.lit(False))
    plain = near.where(~at_edge).withColumn("extra", (F.coalesce((F.col("cell") < F.col("c1")) | ((F.col("cell") == F.col("c1")) & (F.col("fine") < F.col("c2"))), F.lit(True))).cast("int"))
    order = Window.partitionBy("source").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = near.where(at_edge).withColumn("extra", (F.col("c2_before") + F.sum("size").over(order) <= F.col("rest")).cast("int"))
    base = ["doc_id", "source", "size", "row", "source_size", "target", "whole", "place"]
    picked = rows.where("chance is null").select(*base, F.lit(0).alias("extra")).unionByName(rows.where("chance >= 1").select(*base, F.lit(1).alias("extra")))
    picked = durable(picked.unionByName(plain.select(*base, "extra")).unionByName(edge.select(*base, "extra")))

    gaps = picked.groupBy("source", "target").agg(F.sum(F.col("size") * (F.col("whole") + F.col("extra"))).alias("so_far")).select("source", (F.col("target") - F.col("so_far")).alias("gap"))
    left = _by_source(picked.where(f"extra = 0 and size > 0 and whole < {MOST_COPIES}"), durable(gaps), few).where("size < 2 * gap")
    best = left.groupBy("source").agg(F.min_by("row", F.struct(F.abs(F.col("gap") - F.col("size")), F.coalesce("place", F.lit(1.0)), "doc_id", "row")).alias("best"))
    out = _by_source(picked, durable(best), few).withColumn("copies", F.col("whole") + F.col("extra") + F.coalesce((F.col("row") == F.col("best")).cast("int"), F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
