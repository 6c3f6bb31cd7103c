"""The whole run: training of the ranker on past queries, then answers for new ones.

Every stage is a plan over all queries at once; stages that are used more than once are written tables, keyed by their
inputs, so a repeated run picks up finished ones.

    python -m tessera.plans.pipeline --data-dir DIR --work-dir DIR --output DIR --encoder module:function
"""

from __future__ import annotations

import argparse
import importlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import normalize
from tessera.operators import bm25, candidates, dense, encoder, evaluate, features, geo, ingest, ranker, sampling, split
from tessera.sources import tables
from tessera.sources.stages import cached_stage, data_version, exists, fingerprint


class Run:
    """Paths, parameters and the stage cache of a run."""

    def __init__(self, spark: SparkSession, data_dir: str, work_dir: str, load: Callable, c: Config):
        self.spark, self.data, self.work, self.load, self.c = spark, data_dir.rstrip("/"), work_dir.rstrip("/"), load, c

    @cached_property
    def inputs(self) -> dict:
        """What results depend on."""
        version = data_version(self.spark, *(self.path(n) for n in ("benchmark_items", "benchmark_queries", "train")))
        return {"data": self.data, "version": version, "config": asdict(self.c), "encoder": getattr(self.load, "__qualname__", repr(self.load))}

    def path(self, name: str) -> str:
        return f"{self.data}/{name}.parquet"

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return cached_stage(self.spark, self.work, name, self.inputs, make)

    def corpus(self, name: str, table: str, known: DataFrame | None = None) -> DataFrame:
        """Items of a table: one row each (the first), numbered in file order, with vectors."""

        def first() -> DataFrame:
            rows = ingest.file_order(self.spark.read.parquet(self.path(table)))
            types = {f.name: f.dataType for f in tables.StructType.fromDDL(tables.ITEM)}
            rows = rows.select(*[F.col(n).cast(t).alias(n) for n, t in types.items()], "__file", "__row")
            return ingest.keep_first(rows, "item_id", ["__file", "__row"])

        kept = self.stage(f"{name}-first", first)
        numbered = lambda: ingest.number_docs(kept, ["__file", "__row"]).drop("__file", "__row").withColumnsRenamed({"item_title_raw": "title", "item_infm_params_text": "params", "item_description_raw": "description"})
        items = self.stage(f"{name}-items", numbered)
        embed = lambda rows: encoder.encode_items(rows, self.load)
        return self.stage(f"{name}-corpus", lambda: embed(items) if known is None else dense.with_reuse(items, known.select("item_id", "embedding"), embed))

    def channels(self, queries: DataFrame, items: DataFrame, lexical: DataFrame, edges: DataFrame) -> DataFrame:
        c = self.c
        scored = bm25.boosted(bm25.with_places(lexical, queries, items, edges), c)
        return candidates.union_channels(
            {
                "bm25": bm25.retrieve(scored, c.bm25_k, (queries, items) if c.pad_zero else None),
                "global": dense.retrieve(items, queries, c.global_k),
                "exact": dense.retrieve(items, dense.exact_places(queries), c.exact_k, places="places"),
                "transition": dense.retrieve(items, dense.linked_places(queries, geo.linked(edges, c)), c.transition_k, places="places"),
            }
        )

    def pool(self, name: str, queries: DataFrame, items: DataFrame, index: DataFrame, edges: DataFrame) -> DataFrame:
        """Candidates of the queries with all features and channel ranks."""
        terms = bm25.query_terms(queries, self.c)
        lexical = self.stage(f"{name}-lexical", lambda: bm25.lexical(index, terms, self.c))
        pool = self.stage(f"{name}-pool", lambda: candidates.pool(self.channels(queries, items, lexical, edges), self.c))
        made = lambda: features.build(pool, queries, items, lexical, edges, self.c).join(pool.drop("rrf", "channel_count"), ["query_id", "doc"])
        return self.stage(f"{name}-features", made)

    def train(self, items: DataFrame) -> ranker.Ranker:
        c, spark = self.c, self.spark
        saved = f"{self.work}/ranker-v2-{fingerprint(self.inputs)}"
        if exists(spark, f"{saved}/leaves/_SUCCESS"):
            return ranker.Ranker.load(spark, saved)
        train = spark.read.parquet(self.path("train"))
        groups = self.stage("groups", lambda: ingest.query_groups(train))
        held = self.stage("holdout", lambda: split.holdout_texts(groups, c.holdout_share, c.split_seed))
        fit = self.stage("fit", lambda: split.fit_groups(groups, held, split.secondary_keys(groups, held, c.secondary_texts, c.secondary_seed)))
        drawn = self.stage("drawn", lambda: split.ranker_queries(fit, c.train_queries, c.internal_queries, c.ranker_seed))
        # the texts that the ranker learns from don't count in the transitions that it sees
        edges = self.stage("safe-edges", lambda: geo.edges(geo.pairs_of_groups(fit, items, drawn.select("search_query")), c))
        queries = self.stage("drawn-vectors", lambda: encoder.encode_queries(drawn, self.load))
        index = self.stage("local-index", lambda: bm25.postings(items, c))
        pool = self.pool("train", queries, items, index, edges)
        wanted = queries.select("query_id", F.explode("positives").alias("item_id")).join(items.select("item_id", "doc"), "item_id").select("query_id", "doc")
        rows = sampling.labelled(pool, wanted).join(queries.select("query_id", "part"), "query_id")
        rows = self.stage("train-rows", lambda: rows)
        learn, internal = sampling.with_positives(rows.filter("part = 'train'")), rows.filter("part = 'internal'")
        v1 = ranker.train(sampling.sample_first(learn, c), internal, c)
        v2 = ranker.train(sampling.sample_hard(v1.score(learn), c), internal, c)
        v2.save(spark, saved)
        return v2

    def infer(self, local: DataFrame, model: ranker.Ranker, output: str) -> dict:
        c, spark = self.c, self.spark
        items = self.corpus("benchmark", "benchmark_items", local)
        raw = tables.read_parquet(spark, self.path("benchmark_queries"), tables.QUERY).withColumn("search_query", normalize("search_query"))
        queries = self.stage("queries", lambda: encoder.encode_queries(raw, self.load))
        ordered = ingest.file_order(spark.read.parquet(self.path("train")))
        edges = self.stage("edges", lambda: geo.edges(geo.pairs_of_train(ordered, ingest.SEARCH_COLUMNS, ["__file", "__row"]), c))
        index = self.stage("benchmark-index", lambda: bm25.postings(items, c))
        pool = self.pool("benchmark", queries, items, index, edges)
        ranked = ranker.final(model.score(pool), c.answer_k)
        answer = self.stage("answer", lambda: evaluate.answers(ranked, items, queries))
        evaluate.check(answer, queries, items, c.answer_k)
        tables.write_answer(answer, output)
        again = tables.read_answer(spark, output)
        return evaluate.check(again, queries, items, c.answer_k) | {"sha256": tables.digest(again, ["query_id"])}


def run_pipeline(spark: SparkSession, data_dir: str, work_dir: str, output: str, load: Callable, c: Config = Config()) -> dict:  # noqa: B008
    """Trains and answers. Each pool must hold ``answer_k`` items for a valid answer (or the whole corpus if smaller)."""
    began = time.perf_counter()
    run = Run(spark, data_dir, work_dir, load, c)
    for name in ("train", "benchmark_queries", "benchmark_items"):
        if not exists(spark, run.path(name)):
            raise FileNotFoundError(run.path(name))
    local = run.corpus("local", "train")
    result = run.infer(local, run.train(local), output)
    return result | {"total_seconds": round(time.perf_counter() - began, 1)}


def main() -> None:
    p = argparse.ArgumentParser(description="hybrid candidate retrieval and ranking")
    p.add_argument("--data-dir", default="data")
    p.add_argument("--work-dir", default="artifacts")
    p.add_argument("--output", default="answer")
    p.add_argument("--encoder", required=True, help="module:function that returns a function from texts to a matrix")
    p.add_argument("--rounds", type=int, default=Config.rounds)
    a = p.parse_args()
    module, _, name = a.encoder.partition(":")
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    print(json.dumps(run_pipeline(spark, a.data_dir, a.work_dir, a.output, getattr(importlib.import_module(module), name), replace(Config(), rounds=a.rounds)), indent=2))


if __name__ == "__main__":
    main()
