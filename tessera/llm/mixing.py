"""Mixing sources to target weights (op 5): a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1], linear with slope ``b``: its demand rate is
target * (1 + b * (2t - 1)), whose integral over the run is its target. A document copy that lies at cumulative
demand c of its source is read at the time where the integral reaches c; inverting the quadratic gives that time in
closed form. Copies are range-sorted by it.

Targets: sources weigh 3, 1, 2, repeating, in code-point order with null last, and share 150 % of all words; no
target exceeds twice its source, the excess goes to the others by weight (water filling, solved in closed form over
sources sorted by capacity per weight). Each of the two passes over a source has a budget. Documents of more than 1 %
of their source are taken first, longest first, while they fit; the others follow in md5 order, each taken when its
middle lies within what is left. Without ``skip``, a large document that doesn't fit ends the taking of large ones, so
lopsided sources miss their targets; with it, a source misses its target by half of one of its shorter documents, or, if
it has too few of them, by less than the shortest large one that was left. No document is taken more than twice.

Running sums never gather a source in one task: documents fall into 4096 ranges of their md5 per source, range totals
are summed (a table bounded by sources x 4097), and a window runs within each range.

Defined results: a null source is a source of its own; null text has size 0 and no words taken; sources without words
have target 0; ties (equal ids) are ordered by size; identical rows share whatever order they get; repeated rows are
rows of their own; an empty table gives an empty result; extra columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.quality import WORD
from tessera.llm.runtime import table

#: Weights of the sources in order, repeating, and the slopes of their schedules.
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.0, 0.5)
SHARE = 1.5
CAP = 2
#: The table of sources is broadcast up to this many rows (about 100 bytes each).
BROADCAST_SOURCES = 50_000
LARGE_PERCENT = 1


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(s, n, w, target) of each source; ``sized`` has columns s (source) and z (size). One row per source."""
    src = sized.groupBy("s").agg(F.sum("z").alias("n"))
    # the number of sources, not of documents, bounds this window
    rank = F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))
    src = src.select("s", "n", pick(WEIGHTS).alias("w"), pick(SLOPES).alias("b"))
    by_level = Window.orderBy((F.col("n") * CAP / F.col("w")).asc(), F.col("s").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    src = src.select(
        "*",
        (F.sum("n").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("n").over(before), F.lit(0)) * CAP).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    # the level of the water: the first source, by capacity per weight, that isn't filled to its cap
    level = F.col("left") / F.col("w_left")
    open_ = level <= F.col("n") * CAP / F.col("w")
    src = src.withColumn("level", F.min(F.when(open_, F.struct(F.col("n") * CAP / F.col("w"), level.alias("v")))).over(everything)["v"])
    full = F.col("level").isNull() | (F.col("n") * CAP <= F.col("w") * F.col("level"))
    return src.select("s", "n", "b", F.when(full, (F.col("n") * CAP).cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: bool = False, skip: bool = False) -> DataFrame:
    """Per row: d (id), s, z (size), source_size, target, copies and their ``times``; with ``keep`` also the row as ``__row``.

    With ``skip``, large documents that don't fit are stepped over; without, none after the first of them is taken.
    """
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if keep else []
    # k is the source as a key without nulls, so that joins on it keep the partitions of the windows
    key = F.coalesce(F.concat(F.lit("s"), F.col("s")), F.lit("n"))
    rows = docs.select(F.col(id_col).alias("d"), F.col(source).cast("string").alias("s"), size_of(text).alias("z"), *own).withColumn("k", key)
    sizes = table(rows.select("d", "s", "k", "z"), "sizes")  # texts are measured once for all sums below
    t = targets(sizes).withColumnRenamed("n", "source_size").withColumn("k", key).drop("s")
    for c in range(CAP):
        t = t.withColumn(f"budget{c}", F.greatest(F.lit(0.0), F.least(F.col("target") - c * F.col("source_size"), F.col("source_size"))))
    t = table(t, "targets")
    few = t.count() <= BROADCAST_SOURCES

    def placed(x: DataFrame, sources: DataFrame) -> DataFrame:
        """Adds the source's figures and the group of a row."""
        x = x.join(F.broadcast(sources) if few else sources, "k")
        x = x.withColumn("h", F.md5(F.coalesce(F.col("d").cast("string"), F.lit(""))))
        large = F.col("z") * 100 > F.col("source_size") * LARGE_PERCENT
        return x.withColumn("g", F.when(large, F.lit("")).otherwise(F.substring("h", 1, 3))).withColumn("o", F.when(large, -F.col("z")).otherwise(0))

    def numbered(x: DataFrame) -> DataFrame:
        """Adds the words before a row within its group."""
        inner = Window.partitionBy("k", "g").orderBy("o", "h", "d", "z").rowsBetween(Window.unboundedPreceding, -1)
        return x.withColumn("at", F.coalesce(F.sum("z").over(inner), F.lit(0)))

    known = placed(sizes, t)
    heads = numbered(known.filter("g = ''"))  # fewer than 100 / LARGE_PERCENT rows a source
    if skip:
        heads = heads.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "z"))).alias("large"), *[F.first(f"budget{c}").alias(f"own{c}") for c in range(CAP)])
        heads = heads.select("k", *[_stepping("large", f"own{c}").alias(f"step{c}") for c in range(CAP)])
        heads = heads.select("k", *[F.col(f"step{c}")[x].alias(f"{n}{c}") for c in range(CAP) for n, x in (("large", "total"), ("starts", "starts"))])
    else:
        fits = [F.max(F.when(F.col("at") + F.col("z") <= F.col(f"budget{c}"), F.col("at") + F.col("z"))).alias(f"large{c}") for c in range(CAP)]
        heads = heads.groupBy("k").agg(*fits)
    t = table(t.join(heads, "k", "left"), "sources")
    run = Window.partitionBy("k").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = known.filter("g <> ''").groupBy("k", "g").agg(F.sum("z").alias("gz"))
    sums = table(sums.select("k", "g", F.coalesce(F.sum("gz").over(run), F.lit(0)).alias("base")), "ranges")

    x = numbered(placed(rows, t)).join(sums, ["k", "g"], "left")
    for c in range(CAP):
        head = F.coalesce(F.col(f"large{c}"), F.lit(0))
        at = F.col("at") + F.when(F.col("g") == "", 0).otherwise(head + F.coalesce(F.col("base"), F.lit(0)))
        large_fit = at + F.col("z") <= head
        if skip:  # a large document's place follows from those before it that were taken
            start = F.try_element_at(F.col(f"starts{c}"), F.col("at"))
            at, large_fit = F.when(F.col("g") == "", start).otherwise(at), start.isNotNull()
        fit = F.when(F.col("g") == "", large_fit).otherwise(at + F.col("z") / 2 <= F.col(f"budget{c}"))
        # the share of the source's demand before the middle of this copy, and the time when that share is reached
        u = F.least(F.lit(1.0), (c * F.col("source_size") + at + F.col("z") / 2) / F.when(F.col("target") > 0, F.col("target")))
        root = F.sqrt((1 - F.col("b")) * (1 - F.col("b")) + 4 * F.col("b") * u)
        x = x.withColumn(f"t{c}", F.when(fit & (F.col("z") > 0), 2 * u / (1 - F.col("b") + root)))
    times = F.array_compact(F.array(*[F.col(f"t{c}") for c in range(CAP)]))
    return x.select("d", "s", "z", "source_size", "target", F.size(times).alias("copies"), times.alias("times"), *(["__row"] if keep else []))


def _stepping(rows: str, budget: str) -> Column:
    """(total, starts): the words of those rows that fit, one after the other, and per words before a row its start.

    ``rows`` is an array of (at, z), ordered; a row is known by ``at``, the words of all rows before it.
    """
    start = F.struct(F.lit(0).cast("long").alias("total"), F.create_map().cast("map<bigint,bigint>").alias("starts"))

    def step(done: Column, row: Column) -> Column:
        fits = done["total"] + row["z"] <= F.col(budget)
        more = F.map_concat(done["starts"], F.create_map(row["at"], done["total"]))
        return F.struct((done["total"] + F.when(fits, row["z"]).otherwise(0)).alias("total"), F.when(fits, more).otherwise(done["starts"]).alias("starts"))

    return F.aggregate(F.col(rows), start, step)


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", skip: bool = False) -> DataFrame:
    """One row per document with the words that the mix takes from it, range-sorted by its first position."""
    p = plan(docs, id_col, text, source, skip=skip)
    return p.select(
        F.col("d").alias("doc_id"),
        F.col("z").alias("size"),
        "source_size",
        "target",
        (F.col("z") * F.col("copies")).alias("taken"),
        F.round(F.get("times", F.lit(0)), 9).alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", skip: bool = False) -> DataFrame:
    """The mixed corpus: rows of ``docs`` repeated as taken, range-sorted by training position."""
    p = plan(docs, id_col, text, source, keep=True, skip=skip)
    copies = p.select("__row", "d", F.posexplode("times").alias("copy", "at"))
    return copies.orderBy("at", "d", "copy").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
