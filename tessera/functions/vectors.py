"""Vector functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of those vectors of an array whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
    size = F.size(F.get(kept, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size(kept))
