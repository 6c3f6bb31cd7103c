"""Exact dense retrieval: global, within the query's location, within its linked locations.

Queries are cut into blocks of bounded size; each block is shipped to the tasks that scan the documents, which multiply
matrices and keep the k best of each batch and query. A window merges these. No pair of query and document becomes a row
unless it is among the k best of its batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.topk import best_docs

#: Bytes of query vectors that are shipped at once.
SHIPPED = 32 << 20


def _blocks(queries: DataFrame, vector: str, places: str | None) -> Iterator[tuple[list, np.ndarray, list]]:
    """Queries in blocks of bounded size, streamed to the driver one partition at a time."""
    ids, rows, at, size = [], [], [], 0
    for r in queries.select("query_id", vector, *([places] if places else [])).toLocalIterator():
        if r[1] is None:
            continue
        ids.append(r[0])
        rows.append(r[1])
        at.append(r[2] if places else None)
        size += 8 * len(r[1])
        if size >= SHIPPED:
            yield ids, np.array(rows, np.float64), at
            ids, rows, at, size = [], [], [], 0
    if ids:
        yield ids, np.array(rows, np.float64), at


def retrieve(docs: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", query_vector: str = "embedding", places: str | None = None, location: str = "item_location_id", digits: int = 6) -> DataFrame:
    """(query_id, doc, score, rank): the k documents of the greatest inner product, rounded to ``digits``.

    ``places`` names an array column of ``queries``: only documents at these locations count. Queries or documents
    without a vector or a location give no rows.
    """
    id_type = queries.schema["query_id"].dataType
    out = None
    cols = docs.filter(F.col(vector).isNotNull()).select("doc", F.col(vector).cast("array<double>").alias("v"), (F.col(location).cast("string") if places else F.lit(None).cast("string")).alias("at"))
    for ids, q, at in _blocks(queries, query_vector, places):
        scored = cols.mapInArrow(_scorer(ids, q, at if places else None, k, digits), f"query_id {id_type.simpleString()}, doc long, score double")
        out = scored if out is None else out.union(scored)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"query_id {id_type.simpleString()}, doc long, score double")
    return best_docs(out, k)


def _scorer(ids: list, q: np.ndarray, at: list | None, k: int, digits: int) -> Callable:
    wanted: dict[str, list[int]] = {}
    if at is not None:
        for i, places in enumerate(at):
            for p in places or ():
                if p is not None:
                    wanted.setdefault(str(p), []).append(i)
    names = np.array(ids, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if at is None:
                parts = [(np.arange(len(q)), np.arange(len(docs)))]
            else:
                where = np.array(batch.column(2).to_pylist(), dtype=object)
                by_query: dict[int, list[np.ndarray]] = {}
                for p in set(where) & set(wanted):
                    rows = np.flatnonzero(where == p)
                    for i in wanted[p]:
                        by_query.setdefault(i, []).append(rows)
                groups: dict[tuple, list[int]] = {}
                for i, rows in by_query.items():
                    groups.setdefault(tuple(np.sort(np.concatenate(rows))), []).append(i)
                parts = [(np.array(qs), np.array(rows)) for rows, qs in groups.items()]
            for qs, rows in parts:
                for lo in range(0, len(qs), 256):
                    some = qs[lo : lo + 256]
                    scores = np.round(q[some] @ v[rows].T, digits) + 0.0
                    keep = min(k, len(rows))
                    out_q, out_d, out_s = [], [], []
                    least = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                    for i, s, low in zip(some, scores, least, strict=True):
                        e = np.flatnonzero(s >= low)
                        e = e[np.lexsort((docs[rows[e]], -s[e]))[:k]]
                        out_q += [names[i]] * len(e)
                        out_d.append(docs[rows[e]])
                        out_s.append(s[e])
                    yield pa.RecordBatch.from_arrays([pa.array(out_q), pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_s))], ["query_id", "doc", "score"])

    return run


def exact_places(queries: DataFrame) -> DataFrame:
    return queries.withColumn("places", F.array("search_location_id"))


def linked_places(queries: DataFrame, linked: DataFrame) -> DataFrame:
    """Adds the array of the linked locations of each query's location."""
    targets = linked.groupBy(F.col("source").alias("search_location_id")).agg(F.collect_list("target").alias("places"))
    return queries.join(targets, "search_location_id")


def with_reuse(items: DataFrame, known: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = "item_id") -> DataFrame:
    """Items with vectors: those of ``known`` (key, embedding) where there are, else those that ``embed`` makes."""
    old = items.join(known.select(key, "embedding"), key)
    new = embed(items.join(known, key, "left_anti"))
    return old.unionByName(new.select(*old.columns))
