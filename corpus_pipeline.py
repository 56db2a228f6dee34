"""The corpus pipeline: stages over the documents table, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents.  Decisions name rows
by a 128-bit key of their values, so rows without id and rows that share an id
are each judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.durable import shared_path
from tidewell.llm.ids import row_key, with_ids, without_ids
from tidewell.llm.kneser_ney import classify_quality
from tidewell.llm.line_chunk_dedup import remove_repeated_chunks
from tidewell.llm.minhash_dedup import near_duplicates
from tidewell.llm.pareto_mix import mix_sources
from tidewell.llm.winnow_decontam import find_leaks


def _keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """docs with the key of the columns, and the name of the key, which none of docs has."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, row_key(*columns)), name


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's threshold go; trusted are those labelled good and not toxic."""
    keyed, key = _keyed(docs, "doc_id", "text", "lang")
    trusted = with_ids(keyed, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0"))
    verdict = classify_quality(keyed, trusted, id_col=key).where("not kept").select(F.col("doc_id").alias(key))
    return without_ids(keyed, verdict, key).drop(key)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, n_chars follows; so does a document of which no word is left."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeated_chunks(docs, keep=rest).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    value = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col("kept").getField(c) for c in rest}
    if "n_chars" in rest:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(value["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(value[c].alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (five-word shingles, 0.8), and one of the rows that share id and text."""
    keyed, key = _keyed(docs, "doc_id", "text")
    judged = near_duplicates(keyed, shingle=5, percent=80, keep=[key])
    left = without_ids(keyed, judged.where("not kept"), key)
    repeated = keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if repeated.isEmpty():
        return left.drop(key)
    once = with_ids(left, repeated, key).dropDuplicates([key])
    return without_ids(left, repeated, key).unionByName(once).drop(key)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed, key = _keyed(docs, "doc_id", "text")
    leaks = find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).where("n_hit > 0")
    return without_ids(keyed, leaks.select(F.col("doc_id").alias(key)), key).drop(key)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus by document: how many copies and words of each are taken; documents not taken go."""
    return mix_sources(docs).where("copies > 0")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("source mixing", mix),
]

#: Perplexities and signatures have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
