"""The search over items that are read once, against the plans that join and sum; passages against all pairs."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.config import Config, Field
from tessera.functions.text import field_tokens, normalize
from tessera.operators import bm25, geo, matches, passages
from tessera.operators.topk import best_docs
from tessera.plans import queries as plan

C = Config(fields=(Field("title", 4.0), Field("params", 1.0, 12), Field("description", 0.4, 30)))
SIGNALS = [(1, 2, 0.5), (2, 1, 0.25), (3, 1, 0.75)]


def tables(spark, repeat=False):
    rnd = random.Random(5)
    words = "red blue bike car Straße ΣΟΦΟΣ fast slow x1 ёж".split()
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", " ", "-"]) for _ in range(rnd.randint(0, n)))
    some = lambda *x: rnd.choice(x)
    items = [(i, text(3), some(text(3), None), text(12), some(1, 2, 3, None), some(1, 2, None)) for i in range(150)]
    items += [(i + 1000, *items[i % 5][1:]) for i in range(40)]  # ties
    qs = [(f"q{i}", some(text(5), None), some(1, 2, None), some("x1 red", None), some(0, 1, 2, None)) for i in range(11)]
    if repeat:
        items, qs = items + items[:3] + [(None, *items[4][1:])], qs + [("q1", "car", 2, "", 1)]
    i = spark.createDataFrame(items, "doc long, title string, params string, description string, item_location_id long, item_category_id long")
    q = spark.createDataFrame(qs, "query_id string, search_query string, search_location_id long, search_infm_params_text string, search_category long")
    return i.repartition(3), q, spark.createDataFrame(SIGNALS, "source long, target long, signal double")


def rows(df, *cols):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else str(v) for v in (r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize(("repeat", "shipped", "cells"), [(False, 32 << 20, 1 << 20), (False, 1, 30), (True, 1, 30)])
def test_search_equals_joins(spark, monkeypatch, repeat, shipped, cells):
    monkeypatch.setattr(matches, "SHIPPED", shipped)
    monkeypatch.setattr(matches, "CELLS", cells)
    items, queries, signals = tables(spark, repeat)
    if shipped == 1 and not repeat:
        queries = queries.limit(4)
    terms = bm25.query_terms(queries, C)
    lexical = bm25.lexical(bm25.postings(items, C, terms), terms, C).cache()
    m = matches.Matches(items, queries, C)
    assert m.single == (not repeat)
    for boost, edges in ((None, None), ("plain", None), ("geography", signals)):
        scored = lexical.withColumn("score", F.round("lexical", 6)) if boost is None else bm25.boosted(bm25.with_places(lexical, queries, items, edges), C, boost == "geography")
        for k in (7, 500):
            assert rows(m.best(k, boost, edges), "query_id", "doc", "score", "rank") == rows(best_docs(scored, k), "query_id", "doc", "score", "rank")
    pairs = queries.select("query_id").crossJoin(items.filter("doc % 3 = 0").select("doc"))
    assert rows(m.lexical(pairs), "query_id", "doc", "lexical") == rows(lexical.filter("doc % 3 = 0"), "query_id", "doc", "lexical")


def test_search_shuffles_no_pairs(spark):
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    folder = "/root/testdata/sf0.001"
    for q in (plan.bm25_fielded_topk, plan.bm25_geo_topk, plan.bm25_topk):
        assert not any(x in plan_of(q(spark, folder)) for x in ("Join", "HashAggregate"))


def test_postings_read_texts_once(spark):
    items, _, _ = tables(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    items = items.withColumn("description", F.udf(count, StringType()).asNondeterministic()("description"))
    bm25.postings(items, C).collect()
    assert seen.value == 190


def test_tokens_of_a_part_of_the_text(spark):
    texts = ["", " a  b ", "x" * 200, "ΑΣ " * 40, "Σ" * 90, "a  \n b" * 30, " " * 300 + "ab cd" * 9, "İI" * 40, "ab\tc\x1fd" * 20, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    plain = F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce("t", F.lit(""))), F.lit("ё"), F.lit("е")), r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{3000}]+", " "))
    for n in (1, 7, 40):
        wrong = df.filter(field_tokens("t", n) != F.regexp_extract_all(F.substring(plain, 1, n), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
        assert wrong.count() == 0
    assert df.filter(normalize("t") != plain).count() == 0


@pytest.mark.parametrize("shipped", [1, 32 << 20])
def test_passages_equal_all_pairs(spark, monkeypatch, shipped):
    monkeypatch.setattr(passages, "SHIPPED", shipped)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \n𝒳é") for _ in range(rnd.choice([0, 3, 30, 200]))) for _ in range(60)] + [None, ""]
    cut = lambda t: t[(a := rnd.randrange(len(t))) : a + rnd.choice([1, 6, 9, 20, 40, 90])]
    found = ["", "b a", None, "absent passage that is long enough"] + [cut(rnd.choice([t for t in texts if t])) for _ in range(6 if shipped == 1 else 60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc long, text string").repartition(3)
    ps = spark.createDataFrame([(str(i), p) for i, p in enumerate(found)], "query_id string, text string")
    got = sorted(tuple(r) for r in passages.containing(docs, ps).collect())
    want = sorted((str(i), d) for i, p in enumerate(found) for d, t in list(enumerate(texts)) + [(0, texts[0])] if p is not None and t is not None and p in t)
    assert got == want


def test_pairs_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    pairs = spark.range(100).select((F.col("id") % 3).alias("source"), F.udf(count, "long").asNondeterministic()(F.col("id") % 2).alias("target"))
    geo.edges(pairs).collect()
    assert seen.value == 100
