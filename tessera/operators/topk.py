"""Top k per group, with ties to the smaller id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, group: list[str] | str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their 1-based rank. The limit works before the shuffle, too."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_docs(scores: DataFrame, k: int, score: str = "score", query: str = "query_id", doc: str = "doc") -> DataFrame:
    return top_k(scores, query, [F.col(score).desc(), F.col(doc).asc()], k)
