"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and reads it again as the next stage's documents. Columns other
than ``COLUMNS`` are ignored; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import bpe, mixing, quality_rules, secret_scan, simhash
from strandlog.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject; every row is judged by its own text, null and empty texts fail."""
    return quality_rules.reject(docs, COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group, that of the smallest doc_id (null last); texts without words are one group."""
    return simhash.keep_one(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the values of secrets in the texts; null texts stay null, n_chars is the new length."""
    clean = secret_scan.redact_documents(docs.select(*COLUMNS), secret_scan.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal out rows by source weights: one left out goes, one taken twice stands twice; a null source is one more source."""
    return mixing.dealt(docs, COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that the mix holds; null and empty texts have no tokens."""
    import public_tokenizers

    return bpe.digest_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Trained models and graph components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
