"""N-gram Jaccard join (op 3): exact linking of near copies by parity sketches.

A document's set is that of its distinct 3-word shingles as 64-bit hashes. In a parity sketch each shingle flips the bit
that its hash selects; shared shingles cancel out, so the Hamming distance of two sketches is at most the size of the
symmetric difference. Sets of sizes a, b that reach similarity s differ in at most (a + b)(1 - s)/(1 + s) shingles. A
sketch is cut into more blocks than that, by a part of the hash, so linked sets agree on whole blocks: the pigeonhole
join. Sizes lie in bands by a factor of 1/s; a pair spans two neighbouring bands at most, so each set is sketched for its
own band (as the smaller or the equal) and for the one below (as the larger).

Blocks with a few set bits say little, and unrelated sets would meet there. So a sketch has m spare blocks (three for
four that the bound needs), and a set leaves out its m weakest, by the number of set bits and then by a hash of the
pattern. No link is lost: linked sets agree on more than m blocks, these rank alike in both, and the strongest of them
has m weaker ones below it on either side.

Before that, a filter leaves out most sets. Of a fixed share of all hashes (one and a half times what may differ), each
shingle is looked up: one that occurs in no second set is a difference to every other set. Sets with more of those than
may differ link with nothing. Among the sets that stay, the same is asked of all shingles, so that sets which merely
share a passage don't go on; else their chance meetings would chain them into families that grow faster than the input.
Both are sums by key, exact at any number of shingles.

Sets that share a block form families (components over one star per block). Every family is verified in tiles: its
members fall into chunks of bounded text by hash, and each pair of chunks is a task that intersects sets exactly and
returns only a spanning forest of the links. Families of several chunks first meet a few pivots, round by round: members
of the component that grows from these needn't meet each other. Tasks run in waves, none of which ships more text than about the whole
input's, so that disk doesn't grow with the square of a family. Links so found give the components. No pairs are emitted within a group;
exact copies are one set throughout, and of a bucket only its smallest member and its stars are ever joined: a first
pass over the blocks finds those that several sets share, a bitmap of fixed size lets a second pass send only these.
Keys, classes and edges are written as tables, so lost executors redo only what they held.

Defined results: null or empty text has no shingles, links with nothing and is its own component; fewer than three words
make one shingle of the whole sequence; each row is judged by its own text, also where rows share a doc_id (two texts
whose first row bears the same id are one node); repeated rows get a row each; a document whose copies all lack a
doc_id links with nothing and has a null component; extra columns are ignored; an empty table gives
an empty result. Lower-casing touches A-Z only; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import fresh
from tessera.llm import bitmaps
from tessera.llm.components import components
from tessera.llm.runtime import table

WORDS = 3
#: Similarity in percent, as integers so that the test is exact.
PERCENT = 90
#: Spare blocks for each that the bound needs.
SPARE = 0.75
#: Bits of a block, and shingles that a chunk of a family holds on average at most.
BLOCK_BITS = 4096
CHUNK = 1 << 16
#: Members of a family of several chunks that all others meet first.
PIVOTS = 16

_U = np.uint64
_MULS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(256, dtype=np.uint64), 7)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte string, A-Z lower-cased, and where they start and end."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    value = _BYTES[low]
    value[space] = 0
    # each byte is multiplied by a power that depends on its place in the word
    place = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
    value *= _powers(int((ends - starts).max()) + 1)[np.minimum(place, int((ends - starts).max()))]
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)), starts, ends


@lru_cache(maxsize=4)
def _powers_of(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([_U(1)], np.full(n, _U(0x2545F4914F6CDD1D)))), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _powers_of(1 << max(6, n.bit_length()))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h, _, _ = word_hashes(np.frombuffer(text, np.uint8))
    if not len(h):
        return h
    k = min(words, len(h))
    x = np.full(len(h) - k + 1, _U(k))
    for i in range(k):
        x = mix(x * _MULS[i % len(_MULS)] + h[i : len(h) - k + 1 + i])
    return np.unique(x)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(mix(s, 1))) & (2**63 - 1) if len(s) else 0, int(mix(np.array([s.sum(dtype=np.uint64)]), len(s))[0] >> _U(1)) if len(s) else 0


@lru_cache(maxsize=8)
def bands(percent: int, most: int) -> np.ndarray:
    """Lower ends of the size bands up to ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out)


def most_differences(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets with these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def block_keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set's sketch blocks, for its own band and the one below."""
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    lows = bands(percent, 1 << max(10, (2 * n).bit_length()))
    own = int(np.searchsorted(lows, n, "right")) - 1
    keys = []
    for band in {own, max(own - 1, 0)}:
        top = int(lows[band + 1]) - 1  # the largest smaller set of this band, and its largest partner
        needed = most_differences(top, top * 100 // percent, percent) + 1
        blocks = needed + int(needed * SPARE) if needed > 1 else 1
        h = mix(s, 1000 + band)
        bit = (h % _U(blocks)) * _U(BLOCK_BITS) + ((h >> _U(40)) % _U(BLOCK_BITS))
        bit, times = np.unique(bit, return_counts=True)
        bit = bit[times % 2 == 1]  # the bits that are set: those flipped an odd number of times
        at = (bit // _U(BLOCK_BITS)).astype(np.int64)
        code = np.zeros(blocks, np.uint64)
        np.bitwise_xor.at(code, at, mix(bit, 3))  # 64 bits for the pattern of a block
        code = mix(code + mix(np.arange(blocks, dtype=np.uint64), band) * _U(3), band)
        strength = np.lexsort((code, np.bincount(at, minlength=blocks)))
        keys.append(code[strength[blocks - needed :]])
    return np.concatenate(keys).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of a bounded number of rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def part_of(s: np.ndarray, share: float) -> np.ndarray:
    """The shingles of a fixed share of all hashes."""
    return s if share >= 1 else s[mix(s, 77) < _U(int(share * 2**64))]


def sets_of(docs: DataFrame, words: int, share: float) -> DataFrame:
    """(d, n, k1, k2, part) of rows (d, t): the size of a set, its key, and its shingles of a share of all hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sets = [shingles((t.as_py() or "").encode(), words) for t in batch.column(1)]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _lists([part_of(s, share).view(np.int64) for s in sets])], ["d", "n", "k1", "k2", "part"])

    return docs.mapInArrow(run, "d long, n long, k1 long, k2 long, part array<long>")


def alone(held: DataFrame) -> DataFrame:
    """(k1, alone): of rows (k1, h), the number of a set's shingles that no second set has; no row where there is none."""
    one = held.groupBy("h").agg(F.min("k1").alias("k1"), F.max("k1").alias("last")).filter("k1 = last")
    return one.groupBy("k1").agg(F.count("*").alias("alone"))


def able_of(sets: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The rows (k1, node, n) of ``sets`` without those that have too many shingles of their own among ``held`` (k1, h)."""
    x = sets.join(alone(held), "k1", "left").filter(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n"))
    return x.select("k1", "node", "n")


def rows_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (d, t) whose id may be a ``node``."""
    return bitmaps.may_hold(texts.withColumn("h", F.xxhash64("d")), bitmaps.build(nodes.select(F.xxhash64("node").alias("h")), "h"), "h").select("d", "t")


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(k1, keys) of rows (d, t): sketch blocks, once a task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in _pieces(batches):
            k1, keys = [], []
            for t in batch.column(1):
                s = shingles((t.as_py() or "").encode(), words)
                k = set_key(s)
                if len(s) and k not in seen:
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(k)
                    k1.append(k[0])
                    keys.append(block_keys(s, percent))
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), _lists(keys)], ["k1", "keys"])

    return docs.mapInArrow(run, "k1 long, keys array<long>")


def _links(sets: list[np.ndarray], names: list[int], left: list[int], right: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` (indices into ``sets``, sorted by size)."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(sets[j]) for j in right])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate([sets[j] for j in right])
    vocabulary, flat = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(vocabulary) + 1, np.int32)
    forest = []
    for i in left:
        n = len(sets[i])
        lo, hi = np.searchsorted(sizes, [-(-n * percent // 100), n * 100 // percent + 1])
        if lo >= hi:
            continue
        at = np.searchsorted(vocabulary, sets[i])
        at = at[vocabulary[np.minimum(at, len(vocabulary) - 1)] == sets[i]]
        mark[at] = 1
        both = np.add.reduceat(mark[flat[ends[lo] : ends[hi]]], ends[lo:hi] - ends[lo])
        mark[at] = 0
        for k in np.flatnonzero(100 * both >= percent * (n + sizes[lo:hi] - both)):
            j = right[lo + int(k)]
            x, y = find(i), find(j)
            if x != y:
                root[x] = y
                forest.append((names[i], names[j]))
    return forest


def _by_pivots(members: DataFrame, found: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    """Tables of links that a few members of each family of several chunks have, and (family, node, n, settled).

    All open members meet ``PIVOTS`` of their family; those that so come into its largest component are settled and need
    not meet each other. The next round draws the pivots from there, while rounds settle half of what is open.
    """
    links, state, before = [], members.withColumn("settled", F.lit(False)), 0
    while True:
        large = state.filter(F.col("total") > CHUNK)
        left = large.filter("NOT settled").count()
        if not left or links and 2 * left > before:
            return links, state
        before = left
        drawn = Window.partitionBy("family").orderBy(F.xxhash64("k1", F.lit(len(links))), "node")
        pivots = (large.filter("settled") if links else large).withColumn("at", F.row_number().over(drawn)).filter(F.col("at") <= PIVOTS)
        pivots = table(pivots.select("family", "node", "n", "total"), "pivots")
        # slices of a family are no shorter than its pivots, each of which goes to all of them
        slices = pivots.groupBy("family").agg(F.ceil(F.first("total") / F.greatest(F.sum("n"), F.lit(CHUNK))).cast("int").alias("slices"))
        x = found.join(pivots.select("node"), "node").join(slices, "family").withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("chunk", F.lit(-1))
        y = found.join(large.filter("NOT settled").select("node").join(pivots, "node", "left_anti"), "node").join(slices, "family")
        y = y.withColumn("c2", F.pmod(F.xxhash64("k1", "k2", F.lit(6)), F.col("slices")).cast("int")).withColumn("chunk", F.col("c2"))
        tiles = x.unionByName(y).select("family", F.lit(-1).alias("c1"), "c2", "chunk", "k1", "k2", "node", "t")
        links.append(table(verified(tiles), "links"))
        named = components(reduce(DataFrame.union, links))
        own = table(members.join(named, "node", "left"), "own")
        main = own.filter("component is not null").groupBy("family", "component").agg(F.sum("n").alias("size"))
        main = main.groupBy("family").agg(F.max(F.struct("size", "component"))["component"].alias("main"))
        state = table(own.join(main, "family", "left").select(*members.columns, F.coalesce(F.col("component") == F.col("main"), F.lit(False)).alias("settled")), "state")


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    share = min(1.0, 1.5 * (100 - percent) / 100)
    parts = sets_of(texts, words, share)
    ids = table(parts.select(F.col("d").alias("doc_id"), "n", "k1", "k2"), "ids")
    # one node per set: the smallest id among its rows
    classes = ids.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"))
    classes = table(classes, "classes")
    # a shingle that no other set has is a difference to each: a set with too many of them links with nothing
    able = table(able_of(classes.filter("node is not null"), parts.select("k1", F.explode("part").alias("h")), percent), "some")
    whole = sets_of(rows_of(texts, able), words, 1.0)
    able = table(able_of(able, whole.select("k1", F.explode("part").alias("h")), percent), "able")

    chosen = rows_of(texts, able)
    held = sketches(chosen, words, percent).select("k1", F.explode("keys").alias("key"))
    live = held.groupBy("key").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high").select("key", "low")
    live = table(live, "live")
    stars = bitmaps.may_hold(held, bitmaps.build(live, "key"), "key").join(live, "key")
    stars = stars.filter("k1 <> low").select(F.col("k1").alias("a"), F.col("low").alias("b")).distinct()
    family = table(components(stars).withColumnsRenamed({"node": "k1", "component": "family"}), "families")

    members = classes.filter("node is not null").join(family, "k1").select("family", "node", "k1", "k2", "n")
    members = table(members.join(members.groupBy("family").agg(F.sum("n").alias("total")), "family"), "members")
    found = rows_of(texts, members).withColumnRenamed("d", "node").join(members, "node")
    found = table(found.select("family", "node", "k1", "k2", "n", "t"), "texts")

    def verify(key: tuple, batch: pa.Table) -> pa.Table:
        _, c1, c2 = (x.as_py() for x in key)
        entries = {}
        for chunk, k1, k2, node, t in zip(*(batch.column(c) for c in ("chunk", "k1", "k2", "node", "t")), strict=True):
            k = (k1.as_py(), k2.as_py())
            if k not in entries:
                s = shingles((t.as_py() or "").encode(), words)
                if set_key(s) == k:  # else another row with the id of this set's first document
                    entries[k] = (s, node.as_py(), chunk.as_py())
        order = sorted(entries.values(), key=lambda x: (len(x[0]), x[1]))
        left = [i for i, x in enumerate(order) if x[2] == c1]
        right = [i for i, x in enumerate(order) if x[2] == c2]
        forest = _links([x[0] for x in order], [x[1] for x in order], left, right, percent) if left and right else []
        return pa.table({"a": pa.array([x[0] for x in forest], pa.int64()), "b": pa.array([x[1] for x in forest], pa.int64())})

    kind = "a long, b long"
    links, state = _by_pivots(members, found, lambda x: x.groupBy("family", "c1", "c2").applyInArrow(verify, kind))
    rest = F.coalesce(F.sum(F.when(~F.col("settled"), F.col("n"))), F.lit(0))
    family = state.groupBy("family").agg(F.sum("n").alias("total"), rest.alias("rest")).filter("rest > 0")
    small = F.col("total") <= CHUNK
    family = family.select("family", *[F.when(small, F.lit(v)).otherwise(F.ceil(x / CHUNK)).cast("int").alias(c) for c, v, x in (("open", 1, F.col("rest")), ("done", 0, F.col("total") - F.col("rest")))])
    # open members lie in the first chunks, those of the family's settled component in the others
    chunk = F.pmod(F.xxhash64("k1", "k2", F.lit(5)), F.when(F.col("settled") & (F.col("done") > 0), F.col("done")).otherwise(F.col("open"))).cast("int")
    state = state.join(family, "family").withColumn("late", F.col("settled") & (F.col("done") > 0))
    state = table(state.select("node", "n", "late", "open", (F.col("open") + F.col("done")).alias("chunks"), (chunk + F.when(F.col("late"), F.col("open")).otherwise(0)).alias("chunk")), "chunks")
    shipped = state.agg(F.sum(F.col("n") * F.when(F.col("late"), F.col("open")).otherwise(F.col("chunks")))).first()[0] or 0
    waves = max(1, -(-shipped // max(1, ids.agg(F.sum("n")).first()[0] or 0)))

    def tiles(wave: int) -> DataFrame:
        """A chunk meets each chunk of its family once, settled ones only open ones: the rows of one wave's meetings."""
        mine = lambda o: F.pmod(F.xxhash64("family", F.least("chunk", o), F.greatest("chunk", o)), F.lit(waves)) == wave
        others = F.sequence(F.lit(0), F.when(F.col("late"), F.col("open")).otherwise(F.col("chunks")) - 1)
        x = found.drop("n").join(state, "node").withColumn("other", F.explode(F.filter(others, mine)))
        return x.select("family", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "k1", "k2", "node", "t")

    links += [table(tiles(w).groupBy("family", "c1", "c2").applyInArrow(verify, kind), "links") for w in range(waves)]
    named = components(reduce(DataFrame.union, links))
    by_class = classes.join(named, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    out = ids.join(by_class, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The document of the smallest id of each linked group stays, with all rows that bear this id; so do rows without shingles."""
    groups = link(docs, id_col, text, words, percent)
    out = fresh(docs.columns, "gone")
    gone = groups.filter("n_shingles > 0 AND component_id <> doc_id").select(F.col("doc_id").alias(out)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(out), "left_anti")
