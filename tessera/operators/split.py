"""Leakage-safe splits by query text, in hash order, so that any cluster draws the same texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(text: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(text)), 256)


def _first(rows: DataFrame, order: list[Column], n: Column | int) -> DataFrame:
    """The first n rows in the given order. Ranks are counted in ranges of the first sort key, not in one task."""
    h = order[0]
    x = rows.withColumn("__h", h).withColumn("__g", F.substring("__h", 1, 3))
    sizes = x.groupBy("__g").agg(F.count("*").alias("__c"))  # 4096 rows at most
    before = sizes.withColumn("__at", F.coalesce(F.sum("__c").over(Window.orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__g", "__at", F.sum("__c").over(Window.partitionBy()).alias("__all"))
    x = x.join(F.broadcast(before), "__g")
    w = Window.partitionBy("__g").orderBy("__h", *order[1:])
    limit = n(F.col("__all")) if callable(n) else F.lit(n)
    return x.withColumn("draw", F.col("__at") + F.row_number().over(w)).filter(F.col("draw") <= limit).drop("__h", "__g", "__at", "__all")


def holdout_texts(groups: DataFrame, share: float, seed: int, text: str = "search_query") -> DataFrame:
    """ceil(share * number) of the distinct texts."""
    texts = groups.select(text).distinct()
    return _first(texts, [draw_order(text, seed), F.col(text)], lambda n: F.ceil(n * F.lit(share))).select(text)


def secondary_keys(groups: DataFrame, holdout: DataFrame, n: int, seed: int, text: str = "search_query") -> DataFrame:
    """The key of the smallest id of each of n texts that aren't held out and have several keys."""
    warm = groups.join(holdout, text, "left_anti").groupBy(text).agg(F.count("*").alias("keys"), F.min("query_id").alias("query_id")).filter("keys > 1")
    return _first(warm, [draw_order(text, seed), F.col(text)], n).select("query_id")


def fit_groups(groups: DataFrame, holdout: DataFrame, secondary: DataFrame, text: str = "search_query") -> DataFrame:
    return groups.join(holdout, text, "left_anti").join(secondary, "query_id", "left_anti")


def ranker_queries(fit: DataFrame, train: int, internal: int, seed: int, text: str = "search_query") -> DataFrame:
    """One key per text (the smallest id), the first ``train`` texts for training, the next ``internal`` for stopping."""
    best = fit.groupBy(text).agg(F.min_by(F.struct(*fit.columns), "query_id").alias("r")).select("r.*")
    drawn = _first(best, [draw_order(text, seed), F.col(text)], train + internal)
    return drawn.withColumn("part", F.when(F.col("draw") <= train, "train").otherwise("internal")).drop("draw")
