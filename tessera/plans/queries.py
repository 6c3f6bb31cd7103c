"""One query per operator over the driver's tables, each on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import distinct_tokens, field_tokens, key_id, normalize, passage_prompt, query_prompt, tokenize
from tessera.functions.vectors import l2_normalize, mean_pool
from tessera.operators import bm25, candidates, dense, evaluate, features, geo, ingest, ranker, sampling, split
from tessera.operators.matches import Matches
from tessera.plans import fixtures as fx
from tessera.sources.stages import write_stage

C = fx.SMALL
DESCRIPTION = Config(fields=(C.fields[2].__class__("description", 1.0),))


def text_normalize(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "documents").select("doc_id", normalize("text").alias("normalized"))


def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    t = fx.read(s, d, "documents")
    return t.select("doc_id", F.size(tokenize("text")).alias("tokens"), F.size(distinct_tokens("text")).alias("distinct_tokens"), F.size(field_tokens("text", 1000)).alias("tokens_of_1000"))


def prompts(s: SparkSession, d: str) -> DataFrame:
    t = fx.items(s, d)
    return t.select("doc", passage_prompt("title", "description").alias("passage"), query_prompt("title", "params").alias("query"))


def scan_counts(s: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("documents", "benchmark", "embeddings", "lineitem"):
        one = fx.read(s, d, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.union(one)
    return out


def dedup_keep_first(s: SparkSession, d: str) -> DataFrame:
    t = fx.read(s, d, "documents")
    return ingest.keep_first(t.withColumn("__key", F.sha2(normalize("text"), 256)), "__key", ["doc_id"]).select("doc_id", "source")


def doc_numbers(s: SparkSession, d: str) -> DataFrame:
    first = dedup_keep_first(s, d)
    return ingest.number_docs(write_stage(first, "first"), ["doc_id"]).select("doc_id", "doc")


def _groups(s: SparkSession, d: str) -> DataFrame:
    t = fx.read(s, d, "conversations")
    return ingest.query_groups(t.select(F.col("text").alias("search_query"), "role", F.col("conv_id").alias("item_id")), "item_id", ("search_query", "role"))


def query_groups(s: SparkSession, d: str) -> DataFrame:
    return _groups(s, d).select("query_id", "search_query", "role", F.array_join(F.transform("positives", lambda x: x.cast("string")), " ").alias("positives"))


def min_key_per_text(s: SparkSession, d: str) -> DataFrame:
    return _groups(s, d).groupBy("search_query").agg(F.min("query_id").alias("query_id"), F.min_by("role", "query_id").alias("role"))


def key_ids(s: SparkSession, d: str) -> DataFrame:
    t = fx.queries(s, d)
    return t.select("query_id", key_id(F.col("search_infm_params_text"), "search_location_id", F.nullif("search_category", F.lit(0))).alias("key_id"))


def holdout_split(s: SparkSession, d: str) -> DataFrame:
    return split.holdout_texts(_groups(s, d), C.holdout_share, C.split_seed)


def fit_split(s: SparkSession, d: str) -> DataFrame:
    g = write_stage(_groups(s, d), "groups")
    held = split.holdout_texts(g, C.holdout_share, C.split_seed)
    second = split.secondary_keys(g, held, C.secondary_texts, C.secondary_seed)
    return split.fit_groups(g, held, second).select("query_id", "search_query", "role")


def ranker_queries(s: SparkSession, d: str) -> DataFrame:
    g = write_stage(_groups(s, d), "groups")
    fit = split.fit_groups(g, split.holdout_texts(g, C.holdout_share, C.split_seed), g.select("query_id").filter("false"))
    return split.ranker_queries(fit, C.train_queries, C.internal_queries, C.ranker_seed).select("query_id", "search_query", "part")


def split_disjoint(s: SparkSession, d: str) -> DataFrame:
    g = write_stage(_groups(s, d), "groups")
    held = split.holdout_texts(g, C.holdout_share, C.split_seed)
    fit = split.fit_groups(g, held, g.select("query_id").filter("false"))
    return held.intersect(fit.select("search_query")).agg(F.count("*").alias("shared_texts"))


def bm25_idf(s: SparkSession, d: str) -> DataFrame:
    counts = write_stage(bm25.counted(fx.items(s, d, False), DESCRIPTION), "counts")
    df = bm25.term_frequencies(counts).groupBy("field", "term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(bm25.field_lengths(counts)), "field").select("term", "df", F.round(bm25.idf(), 6).alias("idf"))


def bm25_postings(s: SparkSession, d: str) -> DataFrame:
    i = fx.items(s, d, False)
    return bm25.postings(i, C).select("field", "term", "doc", "tf", F.round("weight", 6).alias("weight"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _passages(s, d, None).best(50)


def _passages(s: SparkSession, d: str, chars: int | None) -> Matches:
    """Whole descriptions by query texts alone."""
    return Matches(fx.items(s, d, False), fx.queries(s, d, chars).withColumn("search_infm_params_text", F.lit("")), DESCRIPTION)


def _matches(s: SparkSession, d: str, chars: int | None = fx.QUERY_CHARS) -> Matches:
    return Matches(fx.items(s, d, False), fx.queries(s, d, chars), C)


def bm25_fielded_topk(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).best(50)


def bm25_base_topk(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).best(50, "plain")


def bm25_geo_topk(s: SparkSession, d: str) -> DataFrame:
    return _matches(s, d).best(50, "geography", geo.edges(fx.nation_pairs(s, d), C))


def bm25_padded_topk(s: SparkSession, d: str) -> DataFrame:
    m = _matches(s, d)
    best = write_stage(m.best(C.bm25_k, "geography", geo.edges(fx.nation_pairs(s, d), C)), "best")
    return bm25.padded(best, C.bm25_k, m.queries, m.items).select("query_id", "doc", "score", "rank")


def transition_edges(s: SparkSession, d: str) -> DataFrame:
    e = geo.edges(fx.nation_pairs(s, d), C)
    return e.select("source", "target", "count", F.round("signal", 9).alias("signal"))


def transition_roles(s: SparkSession, d: str) -> DataFrame:
    e = geo.edges(fx.role_pairs(s, d), C)
    return e.select("source", "target", "count", F.round("signal", 9).alias("signal"))


def transition_top3(s: SparkSession, d: str) -> DataFrame:
    return geo.linked(geo.edges(fx.nation_pairs(s, d), C), C).select("source", "target", "rank")


def dense_global_topk(s: SparkSession, d: str) -> DataFrame:
    return dense.retrieve(fx.vectors(s, d), fx.vector_queries(s, d), 100)


def dense_exact_topk(s: SparkSession, d: str) -> DataFrame:
    return dense.retrieve(fx.vectors(s, d), dense.exact_places(fx.vector_queries(s, d)), 20, places="places")


def dense_transition_topk(s: SparkSession, d: str) -> DataFrame:
    links = geo.linked(geo.edges(fx.nation_pairs(s, d), C), C)
    return dense.retrieve(fx.vectors(s, d), dense.linked_places(fx.vector_queries(s, d), links), 20, places="places")


def _candidates(s: SparkSession, d: str, chars: int | None = fx.QUERY_CHARS) -> tuple[DataFrame, Matches, DataFrame, DataFrame]:
    """The queries with vectors, their matches, the transitions and the channels' candidates. Texts go with no vector."""
    m = _matches(s, d, chars)
    signals = write_stage(geo.edges(fx.nation_pairs(s, d), C), "signals")
    links = geo.linked(signals, C)
    q = write_stage(fx.with_vectors(m.queries, s, d, "item_id"), "queries")
    v = write_stage(fx.with_vectors(m.items.select("doc", "item_location_id"), s, d, "doc"), "vectors")
    channels = {
        "bm25": m.best(50, "geography", signals),
        "global": dense.retrieve(v, q, 100),
        "exact": dense.retrieve(v, dense.exact_places(q), 20, places="places"),
        "transition": dense.retrieve(v, dense.linked_places(q, links), 10, places="places"),
    }
    return q, m, signals, candidates.union_channels(channels)


def candidate_union(s: SparkSession, d: str) -> DataFrame:
    p = candidates.pool(_candidates(s, d)[-1], C)
    return p.select("query_id", "doc", "channel_count", *[f"{n}_at" for n in ("bm25", "global", "exact", "transition")])


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return candidates.fuse(candidates.pool(_candidates(s, d)[-1], C), 50).select("query_id", "doc", "rrf", "rank")


def _features(s: SparkSession, d: str, chars: int | None = fx.QUERY_CHARS) -> DataFrame:
    """The pool's features; of the items, only those of the pool are read in full."""
    q, m, signals, c = _candidates(s, d, chars)
    p = write_stage(candidates.pool(c, C), "pool")
    i = write_stage(fx.with_vectors(fx.items(s, d, among=p), s, d, "doc"), "items")
    return features.build(p, q, i, m.lexical(p), signals, C)


def features_39(s: SparkSession, d: str) -> DataFrame:
    return _features(s, d).drop("rrf")


def _labelled_pool(s: SparkSession, d: str) -> DataFrame:
    p = candidates.pool(_candidates(s, d)[-1], C)
    return write_stage(sampling.labelled(p, fx.positives(s, d)), "labelled")


#: Small enough to bind on these pools.
FEW = Config(sampled=60, channel_head=10, hard_negatives=40)


def sample_v1(s: SparkSession, d: str) -> DataFrame:
    return sampling.sample_first(sampling.with_positives(_labelled_pool(s, d)), FEW).select("query_id", "doc", "label")


def _fixed_score() -> Column:
    """A linear stand-in for a model, so that SQL can follow."""
    return F.round(F.col("rrf") * 10 - F.coalesce("bm25_at", F.lit(100)) / 1000, 9)


def hard_negatives(s: SparkSession, d: str) -> DataFrame:
    x = _labelled_pool(s, d).withColumn("model_score", _fixed_score())
    return sampling.hard_negatives(x, FEW.hard_negatives).select("query_id", "doc", "model_score", "rank")


def sample_v2(s: SparkSession, d: str) -> DataFrame:
    x = sampling.with_positives(_labelled_pool(s, d)).withColumn("model_score", _fixed_score())
    return sampling.sample_hard(x, FEW).select("query_id", "doc", "label")


def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    best, found = _passages(s, d, 20).best(50), write_stage(fx.positives(s, d), "positives")
    return evaluate.recall_at(best, found, (1, 5, 10, 50))


def _answer(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, m, _, c = _candidates(s, d)
    return evaluate.answers(candidates.fuse(candidates.pool(c, C), C.answer_k), m.items, m.queries), m.queries, m.items


def submission_rows(s: SparkSession, d: str) -> DataFrame:
    return _answer(s, d)[0]


def submission_violations(s: SparkSession, d: str) -> DataFrame:
    a, q, i = _answer(s, d)
    return evaluate.violations(write_stage(a, "answer"), q, i, C.answer_k)


def submission_stats(s: SparkSession, d: str) -> DataFrame:
    return evaluate.stats(_answer(s, d)[0])


def lambdamart_topk(s: SparkSession, d: str) -> DataFrame:
    """The trained ranker's fifty best of each pool; few rounds, since each is a job over the training rows."""
    f = write_stage(sampling.labelled(_features(s, d, None), fx.positives(s, d)), "features")
    few = Config(rounds=4, min_rows=5, min_gain=0.0, learning_rate=0.3, depth=4)
    model = ranker.train(sampling.with_positives(f), None, few)
    return ranker.final(model.score(f), 50).select("query_id", "doc", F.round("model_score", 6).alias("model_score"), "rank")


def train_pairs(s: SparkSession, d: str) -> DataFrame:
    """Counts of (source, target) over the distinct pairs of key and item of all training rows."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "item_location_id"]
    pairs = geo.pairs_of_train(fx.train(s, d), ("search_query", "search_location_id"), order)
    return pairs.groupBy("source", "target").agg(F.count("*").alias("pairs"))


def mean_pooling(s: SparkSession, d: str) -> DataFrame:
    """Unit vectors of eight neighbouring embeddings each, taken as the tokens of a text, every third one masked."""
    v = fx.read(s, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("text_id"), "vec_id", "embedding")
    rows = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    t = v.groupBy("text_id").agg(rows.alias("x"))  # eight rows a group
    mask = F.transform("x", lambda r: F.when(r["vec_id"] % 3 == 0, 0).otherwise(1))
    pooled = l2_normalize(mean_pool(F.transform("x", lambda r: r["embedding"]), mask))
    return t.select("text_id", F.posexplode(pooled).alias("place", "value")).select("text_id", "place", F.round("value", 6).alias("value"))


def features_not_finite(s: SparkSession, d: str) -> DataFrame:
    """How many of the candidates' rows have an infinite or not-a-number feature."""
    return features.violations(_features(s, d)).agg(F.count("*").alias("violations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_normalize, tokenize_counts, prompts, scan_counts, dedup_keep_first, doc_numbers, query_groups, min_key_per_text, key_ids,
        holdout_split, fit_split, ranker_queries, split_disjoint, bm25_idf, bm25_postings, bm25_topk, bm25_fielded_topk, bm25_base_topk,
        bm25_geo_topk, bm25_padded_topk, transition_edges, transition_roles, transition_top3, dense_global_topk, dense_exact_topk,
        dense_transition_topk, candidate_union, rrf_fusion, features_39, sample_v1, hard_negatives, sample_v2, recall_at_k,
        submission_rows, submission_violations, submission_stats, train_pairs, mean_pooling, features_not_finite, lambdamart_topk,
    )
}
