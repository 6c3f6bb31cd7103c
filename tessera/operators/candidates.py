"""The pool of candidates: the distinct union of channels, with ranks, and their fusion by reciprocal ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import CHANNELS, Config
from tessera.operators.topk import top_k


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """(query_id, doc, channel, rank) of all channels."""
    return reduce(DataFrame.unionByName, [df.select("query_id", "doc", F.lit(name).alias("channel"), F.col("rank").cast("int").alias("rank")) for name, df in channels.items()])


def pool(candidates: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """One row per query and document: the rank in each channel, the number of channels, the fused score."""
    ranks = [F.min(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_at") for name in CHANNELS]
    return candidates.groupBy("query_id", "doc").agg(*ranks, F.count("*").cast("int").alias("channel_count"), F.round(F.sum(1 / (c.rrf + F.col("rank"))), 9).alias("rrf"))


def rank_features(c: Config) -> list[Column]:
    out = []
    for name in CHANNELS:
        at = F.col(f"{name}_at")
        out += [
            F.coalesce(at, F.lit(c.missing_rank)).cast("double").alias(f"{name}_rank"),
            F.coalesce(1 / at, F.lit(0.0)).alias(f"{name}_rr"),
            at.isNotNull().cast("double").alias(f"{name}_present"),
        ]
    return out


def fuse(p: DataFrame, k: int) -> DataFrame:
    return top_k(p, "query_id", [F.desc("rrf"), F.asc("doc")], k)
