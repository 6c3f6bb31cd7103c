"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Since a stage's result is written before the next stage starts, each removes the scratch tables of the one before it.
Every stage but the last returns the columns of ``documents``. A column ``n_chars`` follows the text where a stage edits
it. Empty tables pass through; repeated rows stay rows of their own until the near-duplicate stage, which keeps the rows
of one doc_id of each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, lines, mixing, pieces, quality
from tessera.llm.runtime import scope, table

#: The near-duplicate stage works on shingles of five words and a similarity of 80 % or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    with scope(spark, "pipeline-quality"):
        return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that repeat an earlier one."""
    with scope(spark, "pipeline-lines"):
        out = lines.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    with scope(spark, "pipeline-near"):
        return jaccard.keep_first(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's target, in training order."""
    with scope(spark, "pipeline-mixing"):
        return mixing.mix(docs, skip=True)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the mix."""
    with scope(spark, "pipeline-tokens"):
        return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near copies", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL can't express the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"), "pipeline-results")
    return STAGES[-1][1](spark, docs, sf_dir)
