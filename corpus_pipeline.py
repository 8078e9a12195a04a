"""A corpus pipeline over documents: toxicity, near duplicates, repeated passages, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one with
those and what the mix takes of each row (size, source_size, target, taken; rows of which nothing is taken go).
Null and empty texts pass every stage but the last; further columns pass all, but for those named like what the mix
adds, which it replaces. Cut texts get a new n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontamination, jaccard_join, mixing, suffix_dedup, toxicity
from tidewright.llm.common import materialize


def _small_batches(spark: SparkSession) -> None:
    """Workers get batches of at most 2,000 texts, in this session: five stages share an executor's memory."""
    name, most = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def _n_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return _n_chars(suffix_dedup.remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return _n_chars(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, carry=True).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", cut_benchmark),
    ("mixing", mix_sources),
]
#: Learned scores, connected components and repeated strings are beyond SQL on whole tables; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
