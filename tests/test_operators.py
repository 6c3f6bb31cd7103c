import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import FEATURES, Config
from tessera.operators import bm25, candidates, dense, evaluate, geo, ingest, sampling, split
from tessera.operators.topk import best_docs, top_k


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_feature_names():
    assert len(FEATURES) == 39 and len(set(FEATURES)) == 39


def test_top_k_ties_and_small_groups(spark):
    s = spark.createDataFrame([("q", 3, 1.0), ("q", 1, 1.0), ("q", 2, 2.0), ("p", 9, 0.0)], "query_id string, doc long, score double")
    assert rows(best_docs(s, 2), "query_id", "doc", "rank") == [("p", 9, 1), ("q", 1, 2), ("q", 2, 1)]
    assert best_docs(s, 0).count() == 0
    assert best_docs(s, 100).count() == 4
    wide = {(r.query_id, r.doc) for r in best_docs(s, 3).collect()}
    assert {(r.query_id, r.doc) for r in best_docs(s, 2).collect()} <= wide
    assert top_k(s, ["query_id"], [F.desc("doc")], 1).count() == 2


def test_keep_first_and_numbers(spark):
    df = spark.createDataFrame([(i % 7, i, 100 - i) for i in range(50)], "k int, i int, v int")
    first = ingest.keep_first(df, "k", ["i"])
    assert rows(first, "k", "v") == [(k, 100 - k) for k in range(7)]
    numbered = ingest.number_docs(df.repartition(5).cache(), ["i"])
    assert rows(numbered, "i", "doc") == [(i, i) for i in range(50)]
    assert ingest.number_docs(df.filter("false"), ["i"]).count() == 0
    clash = ingest.number_docs(df.withColumn("__at", F.lit("x")).withColumn("__base", F.lit("y")), ["i"])
    assert clash.columns == ["k", "i", "v", "__at", "__base", "doc"] and clash.filter("doc = i").count() == 50


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_over_many_wide_partitions(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        n, prime = 1_000_000, 1_000_003
        df = spark.range(0, n, 1, 9).select((F.col("id") * 7919 % prime).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        skipped = sorted(set(range(prime)) - {i * 7919 % prime for i in range(n)})  # three keys that don't occur
        numbered = ingest.number_docs(df, ["k"])
        expected = F.col("k") - sum((F.col("k") > x).cast("long") for x in skipped)
        assert numbered.agg(F.count("*"), F.countDistinct("doc"), F.sum((F.col("doc") != expected).cast("long"))).first() == (n, n, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_query_groups_with_nulls(spark):
    df = spark.createDataFrame([("A b", None, "2"), ("a  B", None, "1"), ("a b", 1, "1"), (None, None, "3")], "q string, loc long, item_id string")
    g = ingest.query_groups(df, "item_id", ("q", "loc"))
    assert sorted((r.q, r.loc, r.positives) for r in g.collect() if r.loc is None) == [("", None, ["3"]), ("a b", None, ["1", "2"])]


def test_splits_share_no_text(spark):
    g = spark.createDataFrame([(f"k{i}", f"t{i % 40}") for i in range(100)], "query_id string, search_query string")
    held = split.holdout_texts(g, 0.2, 42)
    assert held.count() == 8
    second = split.secondary_keys(g, held, 5, 43)
    assert second.count() == 5
    fit = split.fit_groups(g, held, second)
    assert fit.join(held, "search_query").count() == 0 and fit.join(second, "query_id").count() == 0
    drawn = split.ranker_queries(fit, 10, 4, 1)
    assert drawn.filter("part = 'train'").count() == 10 and drawn.filter("part = 'internal'").count() == 4
    assert drawn.select("search_query").distinct().count() == 14
    assert rows(split.holdout_texts(g.repartition(7), 0.2, 42), "search_query") == rows(held, "search_query")


def small(spark):
    items = spark.createDataFrame(
        [(0, "red bike", "x", "fast red", 1, 5), (1, "blue bike", None, "", 2, 6), (2, "red red car", "bike", "slow", None, None), (3, "", "", None, 1, 5)],
        "doc long, title string, params string, description string, item_location_id long, item_category_id long",
    )
    queries = spark.createDataFrame([("a", "red bike red", 1, "x", 5), ("b", "car", None, None, 0), ("c", "zzz", 2, None, None)], "query_id string, search_query string, search_location_id long, search_infm_params_text string, search_category long")
    return items, queries


def test_bm25_by_hand(spark):
    items, queries = small(spark)
    c = Config()
    terms = bm25.query_terms(queries, c)
    assert rows(terms.filter("query_id = 'a'"), "term", "query_weight") == [("bike", 1.0), ("red", 1.0), ("x", 0.2)]
    docs = {0: (["red", "bike"], ["x"], ["fast", "red"]), 1: (["blue", "bike"], [], []), 2: (["red", "red", "car"], ["bike"], ["slow"]), 3: ([], [], [])}
    want = {}
    for q, ws in {"a": {"red": 1, "bike": 1, "x": 0.2}, "b": {"car": 1}}.items():
        for f, fw in enumerate((4.0, 1.0, 0.4)):
            avg = sum(len(d[f]) for d in docs.values()) / 4 or 1.0
            for t, w in ws.items():
                df = sum(t in d[f] for d in docs.values())
                for i, d in docs.items():
                    if tf := d[f].count(t):
                        k = 1.2 * (0.25 + 0.75 * len(d[f]) / avg)
                        want[q, i] = want.get((q, i), 0) + fw * w * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + k)
    for index in (bm25.postings(items, c), bm25.postings(items, c, terms)):
        got = {(r.query_id, r.doc): r.lexical for r in bm25.lexical(index, terms, c).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_boosts_and_null_rules(spark):
    items, queries = small(spark)
    lex = queries.select("query_id").crossJoin(items.select("doc")).withColumn("lexical", F.lit(1.0))
    edges = spark.createDataFrame([(1, 2, 9, 0.5)], "source long, target long, count long, signal double")
    got = {(r.query_id, r.doc): r.score for r in bm25.boosted(bm25.with_places(lex, queries, items, edges)).collect()}
    assert got["a", 0] == pytest.approx(3.15) and got["a", 1] == pytest.approx(1.25) and got["a", 2] == 1.0
    assert {got["b", d] for d in range(4)} == {1.0}  # null location, category 0
    assert got["c", 1] == 3.0 and got["c", 2] == 1.0
    base = {(r.query_id, r.doc): r.score for r in bm25.boosted(bm25.with_places(lex, queries, items, None), geography=False).collect()}
    assert base["a", 0] == pytest.approx(1.26)


def test_padding_takes_lowest_documents(spark):
    items, queries = small(spark)
    scores = spark.createDataFrame([("a", 2, 1.5)], "query_id string, doc long, score double")
    got = bm25.retrieve(scores, 3, (queries, items))
    assert rows(got.filter("query_id = 'a'"), "rank", "doc", "score") == [(1, 2, 1.5), (2, 0, 0.0), (3, 1, 0.0)]
    assert rows(got.filter("query_id = 'b'"), "rank", "doc") == [(1, 0), (2, 1), (3, 2)]


def test_transitions_by_hand(spark):
    pairs = [(1, 1)] * 40 + [(1, 2)] * 10 + [(1, 3)] * 4 + [(2, 1)] * 20 + [(None, 2)] * 3
    df = spark.createDataFrame(pairs, "source long, target long")
    prior = 13 / 77
    given = (10 + 100 * prior) / (54 + 100)
    signal = max(0, (given - prior) / (given + prior)) * 10 / 30
    got = {(r.source, r.target): r.signal for r in geo.edges(df).collect()}
    assert (1, 1) not in got and (1, 3) not in got and (2, 1) not in got
    assert got == ({(1, 2): pytest.approx(signal)} if signal > 0 else {})
    e = spark.createDataFrame([(1, t, c, s) for t, c, s in ((2, 5, 0.4), (3, 9, 0.4), (4, 1, 0.9), (5, 1, 0.3), (6, 1, 0.1))], "source long, target long, count long, signal double")
    assert rows(geo.linked(e), "rank", "target") == [(1, 4), (2, 3), (3, 2)]


def test_unknown_item_raises(spark):
    g = spark.createDataFrame([("t", 1, ["a", "zz"])], "search_query string, search_location_id long, positives array<string>")
    items = spark.createDataFrame([("a", 3)], "item_id string, item_location_id long")
    with pytest.raises(Exception, match="unknown item zz"):
        geo.pairs_of_groups(g, items).collect()


@pytest.mark.parametrize("shipped", [1, 32 << 20])
def test_dense_equals_brute_force(spark, monkeypatch, shipped):
    monkeypatch.setattr(dense, "SHIPPED", shipped)
    rnd = random.Random(1)
    v = [(i, rnd.choice([1, 2, 3, None]), [rnd.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(99, 1, None)]
    docs = spark.createDataFrame(v, "doc long, item_location_id long, embedding array<double>").repartition(3)
    qs = [(f"q{i}", rnd.choice([1, 2, None]), [rnd.random() for _ in range(4)]) for i in range(5)]
    q = spark.createDataFrame(qs, "query_id string, search_location_id long, embedding array<double>")
    score = lambda a, b: round(float(np.dot(a, b)), 6)
    best = lambda x, ds: [d for d, _ in sorted(((d, score(x, e)) for d, _, e in ds if e), key=lambda y: (-y[1], y[0]))[:7]]
    got = {}
    for r in dense.retrieve(docs, q, 7).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc)
    assert got == {n: best(x, v) for n, _, x in qs}
    got = {}
    for r in dense.retrieve(docs, dense.exact_places(q), 7, places="places").orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc)
    assert got == {n: best(x, [d for d in v if d[1] == at]) for n, at, x in qs if at is not None}


def test_pool_ranks_and_fusion(spark):
    ch = {"bm25": [("q", 1, 1), ("q", 2, 2)], "global": [("q", 2, 1)], "exact": [], "transition": [("q", 3, 1)]}
    u = candidates.union_channels({n: spark.createDataFrame(r, "query_id string, doc long, rank int") for n, r in ch.items()})
    p = {r.doc: r for r in candidates.pool(u).collect()}
    assert p[2].channel_count == 2 and p[2].bm25_at == 2 and p[2].exact_at is None
    assert p[2].rrf == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    assert [r.doc for r in candidates.fuse(candidates.pool(u), 3).orderBy("rank").collect()] == [2, 1, 3]


def test_sampling_keeps_required_rows(spark):
    c = replace(Config(), sampled=5, channel_head=2, hard_negatives=1)
    r = [("q", d, 1 if d >= 6 else 0, 1 / (d + 1), d + 1 if d < 4 else None, None, None, None, float(-d)) for d in range(14)]
    p = spark.createDataFrame(r, "query_id string, doc long, label int, rrf double, bm25_at int, global_at int, exact_at int, transition_at int, model_score double")
    assert rows(sampling.sample_first(p, c), "doc") == [(d,) for d in (0, 1, *range(6, 14))]  # more than 5 are required
    assert rows(sampling.sample_hard(p, c), "doc") == [(d,) for d in (0, *range(6, 14))]
    few = p.withColumn("label", (F.col("doc") == 13).cast("int"))
    assert rows(sampling.sample_first(few, c), "doc") == [(0,), (1,), (2,), (3,), (13,)]
    assert sampling.with_positives(p.withColumn("label", F.lit(0))).count() == 0


def test_recall_counts_queries_without_hits(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], "query_id string, doc long, rank int")
    rel = spark.createDataFrame([("a", 2), ("a", 9), ("b", 6), ("c", 1)], "query_id string, doc long")
    assert rows(evaluate.recall_at(ranked, rel, (1, 2)), "k", "recall") == [(1, 0.0), (2, round(0.5 / 3, 6))]


def test_answer_rules(spark):
    items = spark.createDataFrame([(i, f"i{i}") for i in range(4)], "doc long, item_id string")
    queries = spark.createDataFrame([("a",), ("b",)], "query_id string")
    ranked = spark.createDataFrame([(q, d, d + 1) for q in "ab" for d in range(3)], "query_id string, doc long, rank int")
    good = evaluate.answers(ranked, items, queries)
    assert rows(good, "query_id", "answer") == [("a", "i0 i1 i2"), ("b", "i0 i1 i2")]
    assert evaluate.check(good, queries, items, 3)["mean_candidates"] == 3.0
    bad = spark.createDataFrame([("a", "i0 i0 zz"), ("a", "i1"), ("x", "")], "query_id string, answer string")
    found = {r.rule: r.violations for r in evaluate.violations(bad, queries, items, 3).collect()}
    assert found == {"answers_of_unknown_queries": 1, "queries_without_answer": 1, "repeated_queries": 1, "wrong_number_of_items": 2, "repeated_items": 1, "unknown_items": 1}
    with pytest.raises(ValueError, match="repeated_queries"):
        evaluate.check(bad, queries, items, 3)


def test_features_that_are_not_finite(spark):
    from tessera.config import FEATURES
    from tessera.operators import features

    fine = [("q", i, *[float(i)] * len(FEATURES)) for i in range(2)] + [("q", 2, *[None] * len(FEATURES))]
    bad = [("q", 3 + i, *[x if j == k else 1.0 for j in range(len(FEATURES))]) for i, (k, x) in enumerate([(0, float("inf")), (5, float("-inf")), (len(FEATURES) - 1, float("nan"))])]
    df = spark.createDataFrame(fine + bad, "query_id string, doc long, " + ", ".join(f"{n} double" for n in FEATURES))
    assert sorted(r.doc for r in features.violations(df).collect()) == [3, 4, 5]
