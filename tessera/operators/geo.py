"""Smoothed transitions between locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import normalize
from tessera.operators.topk import top_k
from tessera.sources.stages import write_stage


def pairs_of_groups(groups: DataFrame, items: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(source, target) of each positive of each group whose text isn't excluded; unknown items raise an error."""
    g = groups if excluded is None else groups.join(excluded, "search_query", "left_anti")
    p = g.select(F.col("search_location_id").alias("source"), F.explode("positives").alias("item_id"))
    known = items.select("item_id", F.col("item_location_id").alias("target"), F.lit(True).alias("__known"))
    x = p.join(known, "item_id", "left")
    return x.select("source", F.when(F.col("__known"), F.col("target")).otherwise(F.raise_error(F.concat(F.lit("unknown item "), F.col("item_id"))).cast("bigint")).alias("target"))


def pairs_of_train(train: DataFrame, columns: tuple[str, ...], order: list[str]) -> DataFrame:
    """(source, target) of each distinct pair of key and item; the first row of a pair tells the item's location."""
    first, *rest = columns
    keyed = train.select(normalize(first).alias(first), *rest, "item_id", "item_location_id", *order)
    w = keyed.groupBy(*columns, "item_id").agg(F.min_by("item_location_id", F.struct(*order)).alias("target"))
    return w.select(F.col("search_location_id").alias("source"), "target")


def edges(pairs: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """(source, target, count, signal): transitions that are more frequent than their target is by itself."""
    counts = write_stage(pairs.groupBy("source", "target").agg(F.count("*").alias("count")), "counts")  # four plans read it
    # all further sums are over the pair counts, which are as many as there are linked locations
    sources = counts.groupBy(F.col("source").alias("s")).agg(F.sum("count").alias("sources"))
    targets = counts.groupBy(F.col("target").alias("t")).agg(F.sum("count").alias("targets"))
    total = counts.agg(F.sum("count").alias("total"))
    # pairs with a null location count in the totals above, but are no edges
    x = counts.join(sources, F.col("source") == F.col("s")).join(targets, F.col("target") == F.col("t")).crossJoin(F.broadcast(total))  # one row
    x = x.filter((F.col("source") != F.col("target")) & (F.col("sources") >= c.min_sources) & (F.col("count") >= c.min_count))
    prior = F.col("targets") / F.col("total")
    given = (F.col("count") + c.prior_weight * prior) / (F.col("sources") + c.prior_weight)
    signal = F.greatest(F.lit(0.0), (given - prior) / (given + prior)) * (F.col("count") / (F.col("count") + c.support_weight))
    return x.withColumn("signal", signal).filter("signal > 0").select("source", "target", "count", "signal")


def linked(e: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """The strongest targets of each source, those of a sufficient signal."""
    strong = e.filter(F.col("signal") >= c.min_signal)
    return top_k(strong, "source", [F.desc("signal"), F.desc("count"), F.asc("target")], c.linked_locations)
