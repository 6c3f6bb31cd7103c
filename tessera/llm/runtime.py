"""Session helpers: the shared scratch folder and cutting lineage by a written table."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session in ``spark.checkpoint.dir``; a temporary one where that is unset in local mode (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir: executors share no folder of this machine")
            base = tempfile.mkdtemp(prefix="tessera-")
        _scratch[app] = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit; the folder then stays with the cluster's clean-up
        pass


_scope: dict[str, str] = {}


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that are written within belong to ``name``; those of the scope before it are removed.

    For chains of operators of which each result is written before the next one starts. Outside of scopes, tables stay
    until the session ends.
    """
    before = _scope.get("last")
    if before and before != name:
        _remove(spark, f"{scratch_dir(spark)}/{before}")
    _scope["now"] = _scope["last"] = name
    try:
        yield
    finally:
        del _scope["now"]


def table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: lineage ends there, and any executor can read it."""
    path = f"{scratch_dir(df.sparkSession)}/{folder or _scope.get('now', 'tables')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
