"""The concepts of the retrieval plans, bound to the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators.passages import containing

#: Thresholds that suit these tables, where signals between nations are weak.
SMALL = replace(Config(), min_signal=0.02, train_queries=20, internal_queries=10, secondary_texts=5)
QUERY_CHARS = 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, attributes: bool = True, among: DataFrame | None = None) -> DataFrame:
    """Documents as items: doc, title, params, description, location, category and attributes.

    Without ``attributes`` the labels aren't met, which would shuffle all texts, unless they would repeat a document.
    ``among`` has the documents (doc) that are wanted.
    """
    d = read(spark, sf_dir, "documents")
    if among is not None:
        d = d.join(among.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    labels = read(spark, sf_dir, "labels")
    attributes = attributes or not labels.groupBy("doc_id").count().filter("count > 1").isEmpty()
    lang = F.coalesce(*[F.when(F.col("lang") == x, i + 1) for i, x in enumerate(("de", "en", "es", "fr"))])
    columns = [
        F.col("doc_id").alias("doc"),
        F.col("doc_id").cast("string").alias("item_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat_ws(" ", "lang", "source").alias("params"),
        F.col("text").alias("description"),
        F.regexp_extract("source", "([0-9]+)$", 1).cast("bigint").alias("item_location_id"),
        lang.cast("bigint").alias("item_category_id"),
    ]
    if not attributes:
        return d.select(*columns)
    return d.join(labels, "doc_id", "left").select(
        *columns,
        F.col("quality").cast("double").alias("item_rating"),
        F.col("n_chars").cast("double").alias("item_rating_reviews_count"),
        F.col("toxic").cast("double").alias("item_is_phone_hidden"),
        F.col("toxic").cast("double").alias("item_is_message_forbidden"),
        F.col("n_chars").cast("double").alias("item_price"),
    )


def queries(spark: SparkSession, sf_dir: str, chars: int | None = QUERY_CHARS) -> DataFrame:
    """Benchmark passages, whole or cut to a prefix, as queries with a location, a category (0: none) and filters."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").cast("string").alias("query_id"),
        (F.col("text") if chars is None else F.substring("text", 1, chars)).alias("search_query"),
        (F.col("item_id") % 20).cast("bigint").alias("search_location_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("search_infm_params_text"),
        (F.col("item_id") % 5).cast("bigint").alias("search_category"),
        "item_id",
    )


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc): documents that hold the passage."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return containing(d, read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text"))


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): the customer's and the supplier's nation of each line item."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("source"))
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("target"))
    bought = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "source")  # the larger table moves once
    return li.join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", "target").join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select("source", "target")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as training rows: the order's priority as text, the customer's nation, a part and its supplier's nation."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderpriority").alias("search_query"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("search_location_id"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("item_location_id"))
    x = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return x.select("search_query", "search_location_id", F.col("l_partkey").cast("string").alias("item_id"), "item_location_id", "l_orderkey", "l_linenumber", "l_suppkey")


def role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): the roles of neighbouring turns of a conversation."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("target"))
    return t.withColumnRenamed("role", "source").join(n, ["conv_id", "turn"]).select("source", "target")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as documents with a location."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("label").cast("bigint").alias("item_location_id"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty vectors as queries (the feature's own query set)."""
    return vectors(spark, sf_dir).filter("doc < 50").select(F.col("doc").cast("string").alias("query_id"), F.col("item_location_id").alias("search_location_id"), "embedding")


def with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Gives each row the vector number key modulo the number of vectors."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__v"), "embedding")
    n = v.agg(F.count("*").alias("__n"))
    return rows.crossJoin(F.broadcast(n)).withColumn("__v", F.col(key) % F.col("__n")).join(v, "__v").drop("__v", "__n")
