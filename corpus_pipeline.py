"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.llm import decontaminate, minhash, packing, quality, suffix_dedup
from grainfold.llm.frames import keep_in_folder
from grainfold.llm.queries import tokenizer_path


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a change of the texts, where the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id."""
    return minhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document with a smaller id has as well."""
    return _recount(suffix_dedup.remove(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated texts without the passages of benchmark items."""
    return _recount(decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", sequences),
]

#: approximate groups, byte strings and a packing search are beyond SQL; the tests compare run() with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep_in_folder(stage(spark, docs, sf_dir), name)
    return docs
