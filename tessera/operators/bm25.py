"""BM25 over weighted fields, with location and category boosts before the cut.

Postings are a long table (field, term, doc, tf, weight). Document frequencies are joined to them by term; averages and
counts per field are one row each. Scoring is one plan over all queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.text import distinct_tokens, field_tokens, let
from tessera.operators.topk import best_docs
from tessera.sources.stages import write_stage


def _counts(tokens: Column) -> Column:
    """The distinct tokens with their counts, by runs of the sorted array."""

    def runs(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        pairs = lambda at: F.transform(at, lambda i, n: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(t)) - i).cast("long").alias("tf")))
        return F.when(F.size(t) > 0, let(first, pairs)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return let(F.sort_array(tokens), runs)


def counted(items: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """(doc, field, len, counts): a row for each item and field, with the counts of its tokens."""
    arrays = [F.struct(F.lit(f.column).alias("field"), field_tokens(f.column, f.limit).alias("tokens")) for f in c.fields]
    x = items.select("doc", F.explode(F.array(*arrays)).alias("f"))
    return x.select("doc", "f.field", F.size("f.tokens").alias("len"), _counts(F.col("f.tokens")).alias("counts"))


def field_lengths(counts: DataFrame) -> DataFrame:
    """(field, n, average): documents, empty ones included, and their mean length (1 where it is 0)."""
    sums = counts.groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("s"))
    return sums.select("field", "n", F.coalesce(F.nullif(F.col("s") / F.col("n"), F.lit(0.0)), F.lit(1.0)).alias("average"))


def repeated(rows: DataFrame, key: str) -> bool:
    """Whether a key is null or in several rows."""
    return not rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).isEmpty()


def term_frequencies(counts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(field, doc, len, term, tf); with ``terms``, of those terms only. Nothing is shuffled unless documents repeat."""
    x = counts.select("field", "doc", "len", F.explode("counts").alias("x")).select("field", "doc", "len", "x.term", "x.tf")
    if terms is not None:
        x = x.join(terms.select("term").distinct(), "term", "left_semi")
    if repeated(counts.select(F.struct("field", "doc").alias("key")), "key"):
        return x.groupBy("field", "doc", "len", "term").agg(F.sum("tf").alias("tf"))
    return x


def postings(items: DataFrame, c: Config = Config(), terms: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(field, term, doc, tf, weight), weight = idf * tf * (k1 + 1) / (tf + norm).

    Texts are read once: their counts are kept as a table. What is shuffled after that are the postings, by term; a
    frequent term may be split there, since the frequencies that meet it are one row each.
    """
    counts = write_stage(counted(items, c), "counts")
    tf = term_frequencies(counts, terms)
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    x = tf.join(df.hint("shuffle_hash"), ["field", "term"]).join(F.broadcast(field_lengths(counts)), "field")  # a row a field
    return x.select("field", "term", "doc", "tf", weight(c).alias("weight"))


def idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))


def weight(c: Config) -> Column:
    norm = c.k1 * (F.lit(1 - c.b) + c.b * F.col("len") / F.col("average"))
    return idf() * F.col("tf") * (c.k1 + 1) / (F.col("tf") + norm)


def query_terms(queries: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """(query_id, term, weight): distinct query tokens weigh 1, distinct filter tokens add their weight."""
    both = F.array(
        F.struct(F.lit(1.0).alias("w"), distinct_tokens("search_query").alias("t")),
        F.struct(F.lit(c.filter_weight).alias("w"), distinct_tokens("search_infm_params_text").alias("t")),
    )
    x = queries.select("query_id", F.explode(both).alias("x")).select("query_id", "x.w", F.explode("x.t").alias("term"))
    return x.groupBy("query_id", "term").agg(F.sum("w").alias("query_weight"))


def lexical(index: DataFrame, terms: DataFrame, c: Config = Config()) -> DataFrame:  # noqa: B008
    """(query_id, doc, lexical): sums over fields and tokens, without boosts."""
    field_weight = F.coalesce(*[F.when(F.col("field") == f.column, F.lit(f.weight)) for f in c.fields])
    x = terms.join(index, "term")
    return x.groupBy("query_id", "doc").agg(F.sum(field_weight * F.col("query_weight") * F.col("weight")).alias("lexical"))


def same(a: Column, b: Column) -> Column:
    """Equality that is false where either is null."""
    return F.coalesce(a == b, F.lit(False))


def category_match() -> Column:
    """A query category of null or 0 matches nothing."""
    return F.coalesce((F.col("search_category") != 0) & (F.col("search_category") == F.col("item_category_id")), F.lit(False))


def with_places(scores: DataFrame, queries: DataFrame, items: DataFrame, signals: DataFrame | None) -> DataFrame:
    """Adds exact (location), category and signal (0 where there is no edge) to rows of (query_id, doc)."""
    q = queries.select("query_id", "search_location_id", "search_category")
    d = items.select("doc", "item_location_id", "item_category_id")
    x = scores.join(q, "query_id").join(d, "doc")
    x = x.withColumn("exact", same(F.col("search_location_id"), F.col("item_location_id"))).withColumn("category", category_match())
    if signals is None:
        return x.withColumn("signal", F.lit(0.0))
    s = signals.select(F.col("source").alias("search_location_id"), F.col("target").alias("item_location_id"), "signal")
    return x.join(s, ["search_location_id", "item_location_id"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))


def boosted(placed: DataFrame, c: Config = Config(), geography: bool = True) -> DataFrame:  # noqa: B008
    """Adds score: the lexical one with boosts. Without ``geography`` the location boost is the plain one."""
    at = c.exact_location if geography else c.base_location
    score = F.col("lexical") * F.when(F.col("exact"), F.lit(at)).otherwise(1.0) * F.when(F.col("category"), F.lit(c.category)).otherwise(1.0)
    if geography:
        score = score * (1 + c.transition_strength * F.col("signal"))
    return placed.withColumn("score", F.round(score, 6))


def retrieve(scores: DataFrame, k: int, pad: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best documents a query. ``pad`` (queries, items) fills short lists with the lowest document numbers."""
    best = best_docs(scores, k)
    return best if pad is None else padded(best, k, *pad)


def padded(best: DataFrame, k: int, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Lists of k documents: short ones are filled with the lowest document numbers."""
    short = queries.select("query_id").join(best.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").withColumn("lack", k - F.coalesce("have", F.lit(0))).filter("lack > 0")
    lowest = items.select("doc").orderBy("doc").limit(k)  # k rows suffice: at most ``have`` of them are taken
    more = short.crossJoin(F.broadcast(lowest)).join(best.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    more = best_docs(more.withColumn("score", F.lit(0.0)), k).filter("rank <= lack").withColumn("rank", F.col("rank") + F.coalesce("have", F.lit(0)))
    return best.select("query_id", "doc", "score", "rank").unionByName(more.select("query_id", "doc", "score", F.col("rank").cast("int")))
