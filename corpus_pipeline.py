"""A training-data pipeline of five of the operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. SQL can't express the stages; tests run them on planted documents, one after the other and whole.
Defined results of every stage: null texts count as empty, rows without an id take part, repeated rows are treated alike, other columns stay as
they are (n_chars follows the text), an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import op4_packing, op6_toxicity, op7_simhash, op9_lines, op10_secrets


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in their order; n_chars follows the text."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op6_toxicity.reject_toxic(docs, op6_toxicity.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines one occurrence stays; documents stay, if need be with an empty text."""
    return _as_documents(op9_lines.dedup_lines(docs, short=True), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return op7_simhash.keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; documents stay."""
    return _as_documents(op10_secrets.redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    return op4_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("secret scans", secrets), ("best-fit packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
