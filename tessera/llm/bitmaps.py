"""Membership filters of a fixed size: bitmaps of hashed keys that are broadcast, whatever the number of keys.

A bitmap has 2 ** BITS bits (16 MB) in rows of 2 ** 15. It only saves work: rows that it lets through by chance are
dropped by the exact joins that follow, and where it fills up all rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27
_ROW = 15


def _bit(key: str) -> Column:
    return F.pmod(F.col(key), F.lit(1 << BITS))


def build(keys: DataFrame, key: str) -> DataFrame:
    """(r, bits): the bitmap of a column of 64-bit hashes."""
    bit = _bit(key)
    rows = keys.select(F.shiftright(bit, _ROW).cast("int").alias("r"), bit.bitwiseAND(F.lit((1 << _ROW) - 1)).alias("bit"))
    return rows.groupBy("r").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(rows: DataFrame, bitmap: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be in the bitmap."""
    b = bitmap.select(F.col("r").alias("__r"), F.col("bits").alias("__bits"))
    bit = _bit(key)
    x = rows.withColumn("__at", bit).join(F.broadcast(b), F.shiftright(F.col("__at"), _ROW).cast("int") == F.col("__r"))
    at = F.col("__at").bitwiseAND(F.lit((1 << _ROW) - 1))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return x.filter(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("__at", "__r", "__bits")
