"""Training rows: which candidates of a query's pool the ranker sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import CHANNELS, Config
from tessera.operators.topk import top_k


def labelled(rows: DataFrame, positives: DataFrame) -> DataFrame:
    """Adds label: 1 where (query_id, doc) is in ``positives``."""
    p = positives.select("query_id", "doc").distinct().withColumn("__hit", F.lit(1))
    return rows.join(p, ["query_id", "doc"], "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def _filled(rows: DataFrame, sampled: int) -> DataFrame:
    """All required rows, then the best fused ones until there are ``sampled``."""
    w = Window.partitionBy("query_id")
    order = w.orderBy(F.desc("required"), F.desc("rrf"), F.asc("doc"))
    x = rows.withColumn("__n", F.row_number().over(order)).withColumn("__need", F.sum(F.col("required").cast("int")).over(w))
    return x.filter(F.col("__n") <= F.greatest(F.col("__need"), F.lit(sampled))).drop("__n", "__need", "required")


def sample_first(pool: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """Positives and the head of each channel, filled up by fusion. ``pool`` has label, rrf and the ranks."""
    head = F.lit(False)
    for name in CHANNELS:
        head = head | F.coalesce(F.col(f"{name}_at") <= c.channel_head, F.lit(False))
    return _filled(pool.withColumn("required", (F.col("label") == 1) | head), c.sampled)


def hard_negatives(scored: DataFrame, n: int) -> DataFrame:
    """Those without label that the model scores highest."""
    return top_k(scored.filter("label = 0"), "query_id", [F.desc("model_score"), F.asc("doc")], n)


def sample_hard(scored: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """Positives and hard negatives under a frozen model, filled up by fusion."""
    w = Window.partitionBy("query_id", "label").orderBy(F.desc("model_score"), F.asc("doc"))
    x = scored.withColumn("__r", F.row_number().over(w))
    return _filled(x.withColumn("required", (F.col("label") == 1) | (F.col("__r") <= c.hard_negatives)).drop("__r"), c.sampled)


def with_positives(rows: DataFrame) -> DataFrame:
    """Rows of the queries that have a positive in their pool."""
    found = rows.filter("label = 1").select("query_id").distinct()
    return rows.join(found, "query_id", "left_semi")
