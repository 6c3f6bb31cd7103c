"""The whole run on a small invented shop, and the sources and sinks around it."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import ranker
from tessera.operators.encoder import hashed_words
from tessera.plans.pipeline import run_pipeline
from tessera.sources import stages, tables
from tessera.streaming.embeddings import keep_encoded

WORDS = "red blue green old new fast slow big small round flat warm cold soft hard".split()
THINGS = "bike car boat lamp desk".split()


def shop(spark, path, seed=1):
    rnd = random.Random(seed)
    item = lambda i: (f"i{i}", f"{rnd.choice(WORDS)} {THINGS[i % 5]}", rnd.choice([None, "x y"]), " ".join(rnd.choices(WORDS, k=6)), i % 3, i % 4, None, rnd.choice([None, 4.5]), float(i), i % 2 == 0, None, float(10 * i))
    items = {i: item(i) for i in range(70)}
    train = []
    for n in range(60):
        for i in rnd.sample([i for i in items if i % 5 == n % 5], 4):
            train.append((f"{WORDS[n % 15]} {THINGS[n % 5]} {n % 12}", n % 3, False, rnd.choice([None, "x"]), rnd.choice([None, 0, i % 4])) + items[i])
    spark.createDataFrame(train + train[:5], tables.TRAIN).write.parquet(f"{path}/train.parquet")
    spark.createDataFrame(list(items.values()) + [items[3]], tables.ITEM).write.parquet(f"{path}/benchmark_items.parquet")
    spark.createDataFrame([(f"q{n}", f"{WORDS[n]} {THINGS[n % 5]}", n % 3, True, None, None) for n in range(6)], tables.QUERY).write.parquet(f"{path}/benchmark_queries.parquet")


C = replace(Config(), rounds=2, min_rows=2, min_gain=0.0, depth=3, train_queries=10, internal_queries=4, secondary_texts=2, min_sources=5, min_count=1, min_signal=0.0, global_k=60, exact_k=10, transition_k=5, sampled=30, channel_head=5, hard_negatives=10, answer_k=20)


def test_run_and_rerun(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run_pipeline(spark, str(tmp_path / "none"), str(tmp_path / "w"), str(tmp_path / "a"), hashed_words(16), C)
    shop(spark, str(tmp_path))
    first = run_pipeline(spark, str(tmp_path), str(tmp_path / "work"), str(tmp_path / "answer"), hashed_words(16), C)
    assert first["validation"] == "PASS" and first["queries"] == 6 and first["min_candidates"] == 20
    again = run_pipeline(spark, str(tmp_path), str(tmp_path / "work"), str(tmp_path / "answer"), hashed_words(16), C)
    assert again["sha256"] == first["sha256"]
    raw = next((tmp_path / "answer").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"query_id,answer\r\nq0,i")


def test_ranker_learns_and_reloads(spark, tmp_path):
    from tessera.config import FEATURES

    rnd = random.Random(2)
    data = []
    for q in range(12):
        for d in range(20):
            good = int(d < 3)
            data.append((f"q{q}", d, good, *[good + rnd.random() if n == "cosine" else (None if n == "item_rating" else rnd.random()) for n in FEATURES]))
    df = spark.createDataFrame(data, "query_id string, doc long, label int, " + ", ".join(f"{n} double" for n in FEATURES))
    model = ranker.train(df, None, replace(C, rounds=3, learning_rate=0.5))
    scored = model.score(df)
    assert ranker.ndcg(scored, 10) > 0.95 > ranker.ndcg(df.withColumn("model_score", -F.col("label")), 10)
    model.save(spark, str(tmp_path / "m"))
    reloaded = ranker.Ranker.load(spark, str(tmp_path / "m")).score(df)
    assert scored.select("query_id", "doc", "model_score").exceptAll(reloaded.select("query_id", "doc", "model_score")).count() == 0
    # leaves as columns agree with the library's own leaf numbers
    x = ranker.vectors(df)
    tree, leaves = model.trees[0], model.leaves[0]
    same = tree.transform(x).select("leaf", ranker.Ranker._step(tree, leaves).alias("v")).distinct().collect()
    assert all(abs(leaves[int(r.leaf)] - r.v) < 1e-12 for r in same)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "ё"), (2, 0.5, 'a"b')], "a long, b double, c string")
    tables.write_parquet(df, f"{tmp_path}/p")
    assert tables.count_rows(spark, f"{tmp_path}/p") == 2
    assert tables.read_parquet(spark, f"{tmp_path}/p", "c string, a bigint").columns == ["c", "a"]
    with pytest.raises(ValueError, match="lacks zz"):
        tables.read_parquet(spark, f"{tmp_path}/p", "zz string")
    tables.write_json_lines(df, f"{tmp_path}/j")
    assert sorted(map(tuple, tables.read_json_lines(spark, f"{tmp_path}/j", "a long, b double, c string").collect())) == sorted(map(tuple, df.collect()))
    tables.write_json(spark, f"{tmp_path}/x.json", {"ё": [1, None]})
    assert tables.read_json(spark, f"{tmp_path}/x.json") == {"ё": [1, None]}
    answer = spark.createDataFrame([("b", ""), ("a", "x y")], "query_id string, answer string")
    tables.write_answer(answer, f"{tmp_path}/a")
    assert sorted(map(tuple, tables.read_answer(spark, f"{tmp_path}/a").collect())) == [("a", "x y"), ("b", "")]
    assert next(tmp_path.glob("a/part-*.csv")).read_bytes() == b"query_id,answer\r\na,x y\r\nb,\r\n"
    assert tables.digest(answer, ["query_id"]) == tables.digest(answer.repartition(3), ["query_id"])


def test_stage_is_made_once_and_redone_after_an_interruption(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert stages.cached_stage(spark, str(tmp_path), "s", {"v": 1}, make).count() == 3
    assert len(made) == 1
    stages.cached_stage(spark, str(tmp_path), "s", {"v": 2}, make)
    next(tmp_path.glob("s-*/_SUCCESS")).unlink()
    for v in (1, 2):
        stages.cached_stage(spark, str(tmp_path), "s", {"v": v}, make)
    assert len(made) == 3


def test_version_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t" / "x.parquet")
    seen = set()
    for n in (3, 4):
        spark.range(n).write.mode("overwrite").parquet(path)
        seen |= {stages.data_version(spark, str(tmp_path / "t")) for _ in range(2)}
    assert len(seen) == 2


def test_stream_encodes_each_item_once(spark, tmp_path):
    seen = []

    def embed(rows):
        seen.append(sorted(r.item_id for r in rows.collect()))
        return rows.withColumn("embedding", F.array(F.lit(1.0)))

    for n, ids in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(i,) for i in ids], "item_id string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("item_id string").parquet(f"{tmp_path}/in")
        keep_encoded(stream, f"{tmp_path}/out", f"{tmp_path}/check", embed).awaitTermination()
    assert seen == [["a", "b"], ["c"]]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
