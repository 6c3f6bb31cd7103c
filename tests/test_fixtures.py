"""The bindings of the retrieval plans, on small tables of their own."""

from tessera.plans import fixtures, queries

PASSAGES = [(0, "one two three four"), (1, "two"), (2, "wo thr"), (3, "absent"), (4, "\n"), (5, ""), (6, None), (7, "b.*c"), (8, "𝒳y")]
TEXTS = [(0, "one two three four"), (1, "two three\n"), (2, ""), (3, None), (4, "ab.*cd 𝒳𝒳y"), (5, "one two  three four")]


def write(spark, path):
    spark.createDataFrame(PASSAGES, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_positives_of_short_passages(spark, tmp_path):
    got = sorted(tuple(r) for r in fixtures.positives(spark, write(spark, tmp_path)).collect())
    assert got == sorted((str(q), d) for q, p in PASSAGES for d, t in TEXTS if p is not None and t is not None and p in t)


def test_queries_may_be_whole_passages(spark, tmp_path):
    long = "word " * 3_000 + "tail"
    spark.createDataFrame([(0, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert fixtures.queries(spark, str(tmp_path), None).first().search_query == long


def test_ranker_reads_whole_passages(spark, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(queries, "_features", lambda s, d, chars=fixtures.QUERY_CHARS: read.append(chars) or 1 / 0)
    try:
        queries.lambdamart_topk(spark, str(tmp_path))
    except ZeroDivisionError:
        pass
    assert read == [None]
