"""Exact top-k search (op 9) by inner product, with a pivot-distance index.

Vectors are turned into integers, floor(scale * x). To search by inner product with distances, each vector gets one more
component that brings all to the same length M (the greatest norm), and queries get a zero there: then
|q - x|**2 = |q|**2 + M**2 - 2 q.x, so nearer means a greater product. Every vector is keyed by its nearest pivot and its
distance to that, and range-sorted by this key into blocks of at most ``BLOCK`` vectors: annuli around pivots.

A query looks first at the block of each of its ``PROBES`` nearest pivots that lies closest in distance; the k-th best
score there is a bound. Then it goes on to just those blocks whose annulus may hold a better vector: by the triangle
inequality nothing in an annulus [r1, r2] around p is nearer to q than r1 - d(q, p) or d(q, p) - r2. Blocks are scored as
integer matrix products and each gives at most k candidates a query; a window merges them. Results are exact, ties go to
the smaller id.

Pivots are ``PIVOTS`` vectors, spread by a farthest-point walk over a sample of the ``SAMPLE`` vectors with the smallest
hashes (the only thing that is sampled; it affects speed, not results). Equal vectors form a class that keeps its k + 1
smallest distinct ids, each at most k times, as more can never be among a query's best; so a vector that a third of all
rows share is one entry. Query rows are numbered, so that rows of one id are searched apart. Queries of
a block are dealt over tasks of at most ``QUERIES`` on average.

Defined results: vectors that are null or empty, or hold null or non-finite components, neither ask nor answer; vectors
of different dimensions don't meet; rows that share an id are entries of their own, and a query's own rows never answer
it; rows without an id take no part; fewer than k candidates give fewer rows; extra columns are ignored; an empty table
gives an empty result. Products must fit 64 bits; where they may not, the search raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import table

SCALE = 64
PIVOTS = 64
SAMPLE = 4096
BLOCK = 2048
PROBES = 2
QUERIES = 16384


def integers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that take part, as arrays of longs."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    x = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(whole, F.lit(False)))
    return x.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<long> column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows, by floating point where that is exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    raise OverflowError("inner products may exceed 64 bits")


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to lifted pivots."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T + (lift[:, None] - pivot_lift[None]) ** 2
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """A farthest-point walk."""
    sample = np.unique(sample, axis=0)
    x = sample.astype(np.float64)
    picked = [0]
    nearest = ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(count, len(x)) and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((x - x[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each row of ``queries``."""
    x = integers(vectors, id_col, vector, scale)
    # without a query's own id, k others remain of a class, or all
    order = Window.partitionBy("v").orderBy("id")
    rows = x.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("rows"))
    few = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    ids = F.array_sort(F.flatten(F.collect_list(F.array_repeat("id", F.col("rows")))))
    classes = table(few.groupBy("v").agg(ids.alias("ids")).withColumn("dim", F.size("v")), "vectors")
    asks = table(integers(queries, id_col, vector, scale).withColumn("dim", F.size("v")).withColumn("q", F.monotonically_increasing_id()), "queries")
    out = None
    for dim in sorted(r["dim"] for r in asks.select("dim").distinct().collect()):  # a few dimensions at most, in practice one
        part = _search(classes.filter(F.col("dim") == dim), asks.filter(F.col("dim") == dim), k)
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _search(classes: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    top = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))).first()[0]
    if top is None:
        return classes.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = classes.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()
    pivots = choose_pivots(np.array([r["v"] for r in sample], np.int64))
    lift_of = lambda m: np.sqrt(np.maximum(top - (m.astype(np.float64) ** 2).sum(1), 0))
    pivot_lift = lift_of(pivots)
    slack = 1e-6 * (1 + top**0.5)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0))
                d = _distances(m, lift_of(m), pivots, pivot_lift)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], ["v", "ids", "pivot", "dist"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most BLOCK neighbours of one pivot."""
        held: list[pa.RecordBatch] = []
        number = 0
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            pivot = rows["pivot"].to_numpy()
            edges = np.flatnonzero(np.diff(pivot)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(pivot)], strict=True):
                for a in range(lo, hi, BLOCK):
                    piece = rows.slice(a, min(BLOCK, hi - a))
                    dist = piece["dist"].to_numpy()
                    m = _matrix(piece["v"])
                    ids = piece["ids"].combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(task << 32) + number]), pa.array([int(pivot[a])], pa.int32()), pa.array([dist.min()]), pa.array([dist.max()]), pa.array([len(m)], pa.int32()), pa.array([m.tobytes()], pa.binary()), pa.array([np.diff(ids.offsets.to_numpy()).tolist()], pa.list_(pa.int32())), pa.array([ids.flatten().to_numpy().tolist()], pa.list_(pa.int64()))],
                        ["block", "pivot", "low", "high", "n", "data", "counts", "ids"],
                    )
                    number += 1

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 4 * BLOCK:
                yield from flush(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from flush(pa.Table.from_batches(held))

    keyed = classes.select("v", "ids").mapInArrow(key, "v array<long>, ids array<long>, pivot int, dist double")
    ranged = keyed.repartitionByRange(F.col("pivot"), F.col("dist"), F.xxhash64("v")).sortWithinPartitions("pivot", "dist", F.xxhash64("v"))
    blocks = table(ranged.mapInArrow(cut, "block long, pivot int, low double, high double, n int, data binary, counts array<int>, ids array<long>"), "index")
    annuli = blocks.select(F.col("block").alias("b"), "pivot", "low", "high")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1))
                d = _distances(m, np.zeros(len(m)), pivots, pivot_lift)
                rank = d.argsort(1).argsort(1)
                n, p = d.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), p)), pa.array(np.tile(np.arange(p, dtype=np.int32), n)), pa.array(d.ravel()), pa.array(rank.ravel().astype(np.int32))], ["q", "pivot", "d", "near"])

    # PIVOTS rows a query
    places = asks.select("q", "v").mapInArrow(ask, "q long, pivot int, d double, near int")
    meet = places.join(annuli, "pivot").withColumn("gap", F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0)))
    square = F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    shards = max(1, -(-asks.count() // QUERIES))
    shard = F.pmod(F.xxhash64("q"), F.lit(shards)).cast("int")

    def score(key: tuple, data: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not data.num_rows or not wanted.num_rows:
            return empty
        counts = np.array(data["counts"][0].as_py())
        ids = np.array(data["ids"][0].as_py(), np.int64)
        m = np.frombuffer(data["data"][0].as_py(), np.int64).reshape(len(counts), -1)
        owner = np.repeat(np.arange(len(counts)), counts)
        by_id = np.argsort(ids, kind="stable")
        sorted_ids = ids[by_id]
        out_q, out_id, out_s = [], [], []
        for lo in range(0, wanted.num_rows, 512):
            part = wanted.slice(lo, 512)
            scores = _exact(_matrix(part["v"]), m)
            own = part["id"].to_numpy()
            for s, lo_id, hi_id in zip(scores, np.searchsorted(sorted_ids, own), np.searchsorted(sorted_ids, own, "right"), strict=True):
                if lo_id < hi_id:  # classes that hold nothing but the query's own rows
                    s[np.bincount(owner[by_id[lo_id:hi_id]], minlength=len(counts)) == counts] = -(2**63 - 1)
            keep = min(k, scores.shape[1])
            best = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]  # each of these classes gives an id at least
            for q, qid, s, least in zip(part["q"].to_pylist(), own, scores, best, strict=True):
                e = np.flatnonzero((s >= least)[owner])
                e = e[ids[e] != qid]
                e = e[np.lexsort((ids[e], -s[owner[e]]))[:k]]
                out_q.append(np.full(len(e), q, np.int64))
                out_id.append(ids[e])
                out_s.append(s[owner[e]])
        return pa.table({"q": np.concatenate(out_q), "id": np.concatenate(out_id), "score": np.concatenate(out_s)})

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = pairs.join(asks, "q").select("b", shard.alias("s"), "q", "id", "v")
        # a block goes to those shards only that hold a query for it
        asked = pairs.select(F.col("b").alias("block"), shard.alias("shard")).distinct()
        salted = blocks.select("block", "data", "counts", "ids").join(asked, "block")
        return salted.groupBy("block", "shard").cogroup(wanted.groupBy("b", "s")).applyInArrow(score, "q long, id long, score long")

    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id"))
    first = meet.filter(F.col("near") < PROBES).withColumn("at", F.row_number().over(Window.partitionBy("q", "pivot").orderBy("gap", "b"))).filter("at <= 1").select("q", "b")
    first = table(first, "probes")
    found = table(scored(first), "first")
    bound = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") == k).select("q", F.col("score").alias("bound"))
    # a better vector is no farther than radius
    radius = bound.join(asks.select("q", square.alias("qq")), "q").select("q", F.sqrt(F.greatest(F.col("qq") + F.lit(top) - 2 * F.col("bound"), F.lit(0.0))).alias("radius"))
    more = meet.join(radius, "q", "left").filter(F.col("radius").isNull() | (F.col("gap") <= F.col("radius") + slack)).select("q", "b").join(first, ["q", "b"], "left_anti")
    every = found.union(scored(table(more, "more")))
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = ranked.join(asks.select("q", F.col("id").alias("query_id")), "q")
    return named.select("query_id", F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
