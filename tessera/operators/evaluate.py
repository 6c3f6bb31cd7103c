"""Recall and the answer: its format, its validation, its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, recall): the mean over queries with a relevant document of the share found in their first k rows."""
    r = relevant.select("query_id", "doc").distinct()
    total = r.groupBy("query_id").agg(F.count("*").alias("total"))
    hits = ranked.join(r, ["query_id", "doc"], "left_semi")
    x = total.join(hits.select("query_id", "rank"), "query_id", "left")
    per = x.groupBy("query_id", "total").agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"k{k}") for k in ks])
    means = per.agg(*[F.avg(F.col(f"k{k}") / F.col("total")).alias(f"k{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(f"k{k}", 6).alias("recall")) for k in ks]))
    return means.select(rows.alias("x")).select("x.*")


def answers(ranked: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer): item ids in rank order, joined by spaces; empty where a query has none."""
    x = ranked.join(items.select("doc", F.col("item_id").cast("string").alias("item_id")), "doc")
    lists = x.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"]), " ").alias("answer"))
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


RULES = ("answers_of_unknown_queries", "queries_without_answer", "repeated_queries", "wrong_number_of_items", "repeated_items", "unknown_items")


def violations(answer: DataFrame, queries: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(rule, violations) for each rule of the answer's format; all must be 0."""
    if answer.columns != ["query_id", "answer"]:
        raise ValueError(f"an answer has the columns query_id and answer, not {answer.columns}")
    known = items.select(F.col("item_id").cast("string").alias("item")).distinct()
    size = known.agg(F.least(F.count("*"), F.lit(k)).alias("size"))
    text = F.coalesce(F.col("answer"), F.lit(""))
    a = answer.select("query_id", F.filter(F.split(text, r"\s+"), lambda x: x != "").alias("ids")).crossJoin(F.broadcast(size))  # one row
    count = lambda df: df.agg(F.count("*").alias("violations"))
    parts = (
        count(answer.join(queries.select("query_id"), "query_id", "left_anti")),
        count(queries.select("query_id").distinct().join(answer, "query_id", "left_anti")),
        count(answer.groupBy("query_id").count().filter("count > 1")),
        count(a.filter(F.size("ids") != F.col("size"))),
        count(a.filter(F.size("ids") != F.size(F.array_distinct("ids")))),
        count(a.select("query_id", F.explode(F.array_distinct("ids")).alias("item")).join(known, "item", "left_anti")),
    )
    out = None
    for name, part in zip(RULES, parts, strict=True):
        row = part.select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.union(row)
    return out


def stats(answer: DataFrame) -> DataFrame:
    """(queries, mean_candidates, min_candidates, max_candidates)."""
    n = F.size(F.filter(F.split(F.coalesce("answer", F.lit("")), r"\s+"), lambda x: x != ""))
    return answer.select(n.alias("n")).agg(F.count("*").alias("queries"), F.round(F.avg("n"), 6).alias("mean_candidates"), F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"))


def check(answer: DataFrame, queries: DataFrame, items: DataFrame, k: int = 50) -> dict:
    """The statistics of a valid answer; raises an error otherwise."""
    broken = {r["rule"]: r["violations"] for r in violations(answer, queries, items, k).collect() if r["violations"]}
    if broken:
        raise ValueError(f"invalid answer: {broken}")
    return stats(answer).first().asDict() | {"validation": "PASS"}
