"""Incremental encoding: new items are encoded as they arrive, known ones are not encoded again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.stages import exists


def keep_encoded(items: DataFrame, path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], key: str = "item_id") -> StreamingQuery:
    """Appends the vectors of items that ``path`` lacks. A batch that is tried again writes to its own folder once more."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates([key])
        if exists(spark, path):
            before = spark.read.option("basePath", path).parquet(path).filter(f"batch <> {number}")
            new = new.join(before.select(key), key, "left_anti")
        embed(new).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
