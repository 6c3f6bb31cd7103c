"""Line dedup (op 4) by a deletion-neighbourhood join, in DataFrame functions only.

Lines are split at \\n; the words of a line are what single spaces separate. A line is removed when an earlier one (by
doc_id, then line number) is equal to it, or, where both have ``MIN_WORDS`` words or more, is at most one word edit
away: one word replaced, inserted or deleted. Whether that earlier line is itself removed doesn't matter. Lines without
any word stay, and so does every document, be it with an empty text.

A line's neighbourhood is itself and all its variants with one word deleted, as 64-bit keys. Lines that differ by a
replaced word share the variant that lacks the same place; where one has a word more, its variant equals the other
line. So the earliest line of a key (of a key and place) stands for all of them: groups are aggregated before the
shuffle and never paired: a first pass finds the keys of several lines, a second one their rows. Each removal is then verified on the words of the two lines.

To emit variants of those lines only that can have a neighbour, a lossless filter comes first: the one edit lies in one
half of a line, so its neighbours share the other half. Lines of which no half occurs in a different line are out. The
rest is told by bitmaps of fixed size, which are broadcast; where they fill up on huge inputs, more
rows pass to the exact joins that follow, with the same result.

Defined results: null and empty texts stay as they are, and so do texts of documents without an id; equal places (rows
that share a doc_id) don't count as earlier, so repeated rows are treated alike; extra columns pass through, whatever
their names; an empty table gives an empty result. Lines of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import fresh
from tessera.llm import bitmaps
from tessera.llm.runtime import table

MIN_WORDS = 5
HAS_WORD = r"{} rlike '[^ \\t\\r\\f\\x0b]'"


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(d, i, line, h) of each line with a word: its document, its number, its text and hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).cast("string").alias("t")).filter("d is not null")
    rows = rows.select("d", F.posexplode(F.split("t", "\n")).alias("i", "line")).filter(HAS_WORD.format("line"))
    return rows.select("d", "i", "line", F.xxhash64("line").alias("h"))


def _place(seen: DataFrame) -> tuple[Callable[[Column, Column], Column], Callable[[Column], list[Column]]]:
    """One number that orders (d, i), and its inverse: a long where ids and line numbers leave room, else a decimal."""
    r = seen.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("i").alias("lines")).first()
    lo, hi, width = r["lo"] or 0, r["hi"] or 0, 1 << ((r["lines"] or 0) + 1).bit_length()
    kind = "long" if (hi - lo + 1) * width < 1 << 62 else "decimal(38,0)"
    to = lambda d, i: ((d.cast("decimal(20,0)") - lo).cast(kind) * F.lit(width).cast("long") + i).cast(kind)
    if kind == "long":
        to = lambda d, i: (d - F.lit(lo)) * F.lit(width).cast("long") + i
    return to, lambda p: [(F.floor(p / width) + lo).cast("long") if kind != "long" else F.shiftright(p, width.bit_length() - 1) + F.lit(lo), (p % width).cast("int")]


def _half_keys(lines: DataFrame) -> DataFrame:
    """Adds ``halves``: keys of both halves of a line of n words, as n - 1 words' neighbour (a, b) and as n + 1's (c, d).

    Of the four substrings two are the same: with n odd the fronts, with n even the backs.
    """
    x = lines.withColumn("n", F.expr("octet_length(line) - octet_length(replace(line, ' ', '')) + 1"))
    enough = F.col("n") >= MIN_WORDS
    x = x.withColumn("front", F.when(enough, F.expr("substring_index(line, ' ', int((n - 1) / 2))")))
    x = x.withColumn("back", F.when(enough, F.expr("substring_index(line, ' ', -int(n / 2))")))
    return x.withColumn("halves", F.when(enough, F.expr("""array(
        xxhash64(front, n - 1, 1), xxhash64(back, n - 1, 2),
        xxhash64(IF(n % 2 = 1, front, substring_index(line, ' ', int(n / 2))), n, 1),
        xxhash64(IF(n % 2 = 0, back, substring_index(line, ' ', -int(n / 2) - 1)), n, 2))""")))


def _with_words(lines: DataFrame) -> DataFrame:
    return lines.withColumn("w", F.split("line", " ")).withColumn("n", F.size("w"))


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, i, of_d, of_i): the lines to remove, by document and number, each with the earliest line that it repeats."""
    lines = _lines(docs, id_col, text)
    seen = table(_half_keys(lines).select("d", "i", "h", F.xxhash64("line", F.lit(1)).alias("h2"), "halves"), "lines")
    place, back = _place(seen)
    at = place(F.col("d"), F.col("i"))

    first = seen.select(at.alias("pos"), "h", "h2")
    low = first.groupBy("h", "h2").agg(F.min("pos").alias("of"), F.max("pos").alias("last")).filter("of < last").drop("last")
    equal = table(first.join(low, ["h", "h2"]).filter("of < pos").select("pos", "of"), "equal")

    halves = seen.select(at.alias("pos"), "d", "h", F.explode("halves").alias("k"))
    shared = halves.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("k")
    # only the first of equal lines can remove another line or be removed for being near one
    some = table(bitmaps.may_hold(halves, bitmaps.build(shared, "k"), "k").select("pos", "d", "h").distinct(), "halves")
    some = table(some.join(equal, "pos", "left_anti"), "some")
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).cast("string").alias("t")).withColumn("k", F.xxhash64("d"))
    texts = bitmaps.may_hold(texts, bitmaps.build(some.select(F.xxhash64("d").alias("k")), "k"), "k")
    near = bitmaps.may_hold(_lines(texts, "d", "t"), bitmaps.build(some, "h"), "h")
    near = near.select(at.alias("pos"), "line").join(some.select("pos"), "pos", "left_semi")
    near = table(_with_words(near).drop("line"), "near")

    # keys of several places first, then the rows of those keys
    variants = _variants(near)
    several = variants.groupBy("k").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).filter("a < b").select("k")
    several = table(several, "keys")
    met = table(bitmaps.may_hold(variants, bitmaps.build(several, "k"), "k").join(several, "k", "left_semi").select("k", "i", "pos"), "met")

    replaced = met.filter("i >= 0").groupBy("k", "i").agg(F.min("pos").alias("of"))
    ends = met.groupBy("k").agg(F.min(F.when(F.col("i") < 0, F.col("pos"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("pos"))).alias("cut"))
    pairs = met.join(replaced, ["k", "i"]).select("pos", "of")
    pairs = pairs.union(met.join(ends, "k").select("pos", F.when(F.col("i") < 0, F.col("cut")).otherwise(F.col("whole")).alias("of")))
    pairs = pairs.filter("of < pos").distinct()

    a = near.select("pos", F.col("w").alias("a"), F.col("n").alias("na"))
    b = near.select(F.col("pos").alias("of"), F.col("w").alias("b"), F.col("n").alias("nb"))
    checked = pairs.join(a, "pos").join(b, "of").filter(_one_edit("a", "na", "b", "nb")).select("pos", "of")
    x = equal.union(checked).groupBy("pos").agg(F.min("of").alias("of"))
    return x.select(*[c.alias(n) for c, n in zip([*back(F.col("pos")), *back(F.col("of"))], ("d", "i", "of_d", "of_i"), strict=True)])


def _variants(near: DataFrame) -> DataFrame:
    """(pos, i, k): the key of a line without its word i, and of the whole line at i = -1.

    A key is the exclusive or of the hashes of (word, place). Let e be such a hash at the word's own place combined with
    the one at the place before; then the line without word i has the e of all words before i, and the shifted hashes of
    the words after it. The running combination of e takes log n passes over the array, so a variant costs no more than
    these, however long the line.
    """
    x = near.select("pos", "n", F.expr("transform(w, (x, j) -> xxhash64(x, j - 1))").alias("b"), F.expr("transform(w, (x, j) -> xxhash64(x, j))").alias("a"))
    x = x.select("pos", "n", "b", F.expr("aggregate(b, 0L, (z, y) -> z ^ y)").alias("all"), F.expr("""
        aggregate(sequence(0, int(ceil(log2(n)))), zip_with(a, b, (x, y) -> x ^ y), (p, s) ->
          transform(p, (y, j) -> IF(j >= shiftleft(1, s), y ^ p[j - shiftleft(1, s)], y)))""").alias("e"))
    keys = F.expr("concat(array(all ^ e[n - 1]), transform(b, (y, j) -> all ^ y ^ IF(j > 0, e[j - 1], 0L)))")
    return x.select("pos", F.posexplode(keys).alias("i", "k")).withColumn("i", F.col("i") - 1)


def _one_edit(a: str, na: str, b: str, nb: str) -> Column:
    """Whether two arrays of words are one edit apart at most."""
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x <=> y), z -> NOT z)) <= 1"
    longer = lambda p, np, q: (  # noqa: E731  p has one word more than q
        f"aggregate(array(array_position(zip_with(slice({p}, 1, {np} - 1), {q}, (x, y) -> x <=> y), false)), false, "
        f"(z, j) -> j = 0 OR slice({p}, int(j) + 1, {np}) = slice({q}, int(j), {np}))"
    )
    return F.expr(f"CASE {na} - {nb} WHEN 0 THEN {same} WHEN 1 THEN {longer(a, na, b)} WHEN -1 THEN {longer(b, nb, a)} ELSE false END")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` without the removed lines; with ``counts`` also n_lines and n_removed (of lines with a word)."""
    d, gone = fresh(docs.columns, "d"), fresh(docs.columns, "gone")
    removed = removals(docs, id_col, text).groupBy(F.col("d").alias(d)).agg(F.collect_set("i").alias(gone))  # within one document
    x = docs.join(removed, F.col(f"`{id_col}`").cast("long") == F.col(d), "left")
    left = F.expr(f"CASE WHEN {gone} IS NULL THEN `{text}` ELSE array_join(filter(split(`{text}`, '\\n'), (l, i) -> NOT array_contains({gone}, i)), '\\n') END")
    n_lines = F.expr(rf"size(filter(split(coalesce(`{text}`, ''), '\n'), l -> {HAS_WORD.format('l')}))").cast("long").alias("n_lines")
    n_removed = F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")
    return x.select(*[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *([n_lines, n_removed] if counts else []))
