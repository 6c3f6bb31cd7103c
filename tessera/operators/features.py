"""The 39 features of a candidate, as one plan.

Scores don't come from the channels' cut lists: lexical scores are joined uncut (0 where nothing matches) and cosines are
computed for every candidate; only the rank features use the channels. Maxima and ranges are over a query's pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import FEATURES, Config
from tessera.functions.text import distinct_tokens, log_positive, ratio
from tessera.functions.vectors import dot
from tessera.operators.bm25 import boosted, with_places
from tessera.operators.candidates import rank_features


def _shared(tokens: Column, of: Column) -> Column:
    return F.size(F.array_intersect(tokens, of)).cast("double")


def item_side(items: DataFrame, c: Config) -> DataFrame:
    t, p, d = c.fields
    flag = lambda x: F.col(x).cast("double")
    return items.select(
        "doc",
        "item_location_id",
        "item_category_id",
        distinct_tokens(t.column, t.limit).alias("t_tok"),
        distinct_tokens(p.column, p.limit).alias("p_tok"),
        distinct_tokens(d.column, d.limit).alias("d_tok"),
        F.col("embedding").alias("d_vec"),
        flag("item_rating").alias("item_rating"),
        log_positive("item_rating_reviews_count").alias("log_reviews"),
        flag("item_is_phone_hidden").alias("phone_hidden"),
        flag("item_is_message_forbidden").alias("message_forbidden"),
        log_positive("item_price").alias("log_price"),
    )


def query_side(queries: DataFrame) -> DataFrame:
    return queries.select(
        "query_id",
        "search_location_id",
        "search_category",
        distinct_tokens("search_query").alias("q_tok"),
        distinct_tokens("search_infm_params_text").alias("f_tok"),
        F.char_length("search_query").cast("double").alias("query_chars"),
        F.col("embedding").alias("q_vec"),
    )


def build(pool: DataFrame, queries: DataFrame, items: DataFrame, lexical: DataFrame, signals: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """(query_id, doc, the features in order, channel data of the pool)."""
    x = pool.join(lexical, ["query_id", "doc"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    x = boosted(with_places(x, queries, items, signals), c).drop("search_location_id", "item_location_id", "search_category", "item_category_id")
    x = x.join(query_side(queries).drop("search_location_id", "search_category"), "query_id")
    x = x.join(item_side(items, c).drop("item_location_id", "item_category_id"), "doc")
    x = x.withColumn("cos", F.round(dot(F.col("q_vec"), F.col("d_vec")), 6))
    q = Window.partitionBy("query_id")
    q_len, title = F.size("q_tok").cast("double"), _shared(F.col("q_tok"), F.col("t_tok"))
    params = _shared(F.col("q_tok"), F.col("p_tok"))
    made = {
        "bm25_score": F.col("score"),
        "bm25_relative": ratio(F.col("score"), F.max("score").over(q), 1e-6),
        "lexical_score": F.col("score") / F.when(F.col("exact"), c.exact_location).otherwise(1.0) / (1 + c.transition_strength * F.col("signal")) / F.when(F.col("category"), c.category).otherwise(1.0),
        "cosine": F.col("cos"),
        "cosine_gap_to_best": F.col("cos") - F.max("cos").over(q),
        "cosine_range_normalized": ratio(F.col("cos") - F.min("cos").over(q), F.max("cos").over(q) - F.min("cos").over(q), 1e-6),
        "channel_count": F.col("channel_count").cast("double"),
        "exact_location": F.col("exact").cast("double"),
        "transition_signal": F.col("signal"),
        "category_match": F.col("category").cast("double"),
        "query_title_overlap": title,
        "query_title_coverage": ratio(title, q_len, 1.0),
        "title_query_coverage": ratio(title, F.size("t_tok").cast("double"), 1.0),
        "query_params_overlap": params,
        "query_params_coverage": ratio(params, q_len, 1.0),
        "query_description_coverage": ratio(_shared(F.col("q_tok"), F.col("d_tok")), q_len, 1.0),
        "filter_params_coverage": ratio(_shared(F.col("f_tok"), F.col("p_tok")), F.size("f_tok").cast("double"), 1.0),
        "query_tokens": q_len,
        "query_chars": F.col("query_chars"),
        "filter_tokens": F.size("f_tok").cast("double"),
        "title_tokens": F.size("t_tok").cast("double"),
        "params_tokens": F.size("p_tok").cast("double"),
    }
    own = [F.round(e, 6).alias(n) for n, e in made.items()]
    kept = [F.round(F.col(n), 6).alias(n) for n in ("item_rating", "log_reviews", "phone_hidden", "message_forbidden", "log_price")]
    wide = x.select("query_id", "doc", "rrf", *own, *kept, *rank_features(c))
    return wide.select("query_id", "doc", "rrf", *FEATURES)


def violations(features: DataFrame) -> DataFrame:
    """Rows with an infinite or not-a-number feature (nulls are allowed)."""
    bad = None
    for n in FEATURES:
        x = F.col(n).isNotNull() & (F.isnan(n) | (F.abs(F.col(n)) == float("inf")))
        bad = x if bad is None else bad | x
    return features.filter(bad)
