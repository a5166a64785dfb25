"""Documents to training tokens: five stages, each on all that the one before kept.

Each stage but the last returns rows of documents with all their columns unchanged.
Between stages a table is written to the cluster's shared folder and read again; the one
before is deleted then.

In every stage rows with a null id are kept or dropped by their text as others are, extra
columns stay as they are whatever their names, repeated rows are each judged (of near
duplicates one stays, so exact repeats of an id do not pass ``near_duplicates``), and an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respondex.llm import bpe, decontaminate, jaccard_join, language, quality
from respondex.plans.shipping import ship
from respondex.plans.staging import discard, staged


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of at least 0.2; the model is learned from those with a label.

    Null and empty texts, and texts without a letter, have no language and go.
    """
    ship(spark)
    return language.with_language(docs, language.learn(docs, "doc_id", "text", "lang"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by the labels given for some; null and empty texts are scored as documents without terms."""
    ship(spark)
    return quality.good(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the lowest id, of each group linked by five-word shingles at a similarity of 0.8.

    Null and empty texts and rows with a null id link with nothing and stay; of rows that share an id one stays.
    """
    ship(spark)
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; null and empty texts have no words and stay."""
    ship(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them; null texts count as empty."""
    ship(spark)
    return bpe.encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL can't express the learned stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
