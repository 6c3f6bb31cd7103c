"""Items: keep-first deduplication and dense document numbers; queries: groups of positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import fresh
from tessera.functions.text import key_id, normalize
from tessera.sources.stages import write_stage

SEARCH_COLUMNS = ("search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category")


def file_order(df: DataFrame) -> DataFrame:
    """Adds the order of rows in a scanned table: file, then row."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def keep_first(df: DataFrame, key: str | Column, order: list[str | Column]) -> DataFrame:
    """The first row of each key. A partial top 1 runs before the shuffle, so repeated keys don't pile up in a task."""
    key = F.col(key) if isinstance(key, str) else key
    n = fresh(df.columns, "n")
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(n, F.row_number().over(w)).filter(F.col(n) <= 1).drop(n)


def number_docs(df: DataFrame, order: list[str], name: str = "doc") -> DataFrame:
    """Dense 0-based numbers in the given total order, without a single-task sort.

    Rows are sorted and written once, each with its partition and its place there; what follows reads that table, so all
    passes see the same partitions, whatever Spark would make of the sort a second time. The sizes of the partitions (a
    row each) give the number at which each starts.
    """
    at, base = fresh(df.columns, "at"), fresh(df.columns, "base")
    # the partition in the upper 31 bits, the row within it in the lower 33
    held = write_stage(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, 33)
    sizes = held.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    starts = sizes.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    x = held.join(F.broadcast(starts), part == F.col("p"))
    return x.select(*df.columns, (F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def query_groups(train: DataFrame, item: str = "item_id", columns: tuple[str, ...] = SEARCH_COLUMNS) -> DataFrame:
    """(query_id, the key columns, positives): one row per normalised key, with its sorted distinct items."""
    first, *rest = columns
    keys = train.select(normalize(first).alias(first), *rest, item)
    return keys.groupBy(*columns).agg(F.array_sort(F.collect_set(item)).alias("positives")).select(key_id(*columns).alias("query_id"), *columns, "positives")
