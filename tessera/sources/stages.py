"""Stages that are written once: reuse by fingerprint, and plain tables that cut lineage."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir: executors share no folder of this machine")
    return _temporary.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tessera-"))


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table of the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def data_version(spark: SparkSession, *paths: str) -> str:
    """Changes with the path, length or time of any file below ``paths``; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    r = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("h")).first()
    return f"{r['n']}-{r['h']}"


def fingerprint(inputs: dict) -> str:
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached_stage(spark: SparkSession, folder: str, name: str, inputs: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table for these inputs (a fingerprint: configuration, paths, versions), made where it is missing.

    Only a finished write leaves the marker that this looks for, so an interrupted run is never taken for a result.
    """
    path = f"{folder.rstrip('/')}/{name}-{fingerprint(inputs)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
