"""Tables in and out: schemas that are checked, and the formats of inputs and answers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERY = "query_id string, search_query string, search_location_id bigint, search_is_delivery_search boolean, search_infm_params_text string, search_category bigint"
ITEM = (
    "item_id string, item_title_raw string, item_infm_params_text string, item_description_raw string, item_location_id bigint, "
    "item_category_id bigint, item_microcat_id bigint, item_rating double, item_rating_reviews_count double, "
    "item_is_phone_hidden boolean, item_is_message_forbidden boolean, item_price double"
)
TRAIN = QUERY.split(", ", 1)[1] + ", " + ITEM
ANSWER = "query_id string, answer string"
EDGES = "source bigint, target bigint, count bigint, signal double"


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The named columns, cast to the expected types; a missing one is an error. Other columns aren't read."""
    want = StructType.fromDDL(schema)
    df = spark.read.parquet(path)
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows by the files' footers, as far as Spark can."""
    return spark.read.option("aggregatePushdown", "true").parquet(path).count()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small value, indented, through the file system of the path."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_answer(answer: DataFrame, path: str) -> None:
    """CSV with a header and \\r\\n, one file; an answer is a row per query."""
    out = answer.select("query_id", "answer").orderBy("query_id").coalesce(1)
    out.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("lineSep", "\r\n").option("enforceSchema", False).schema(ANSWER).csv(path).fillna({"answer": ""})


def digest(df: DataFrame, order: list[str]) -> str:
    """SHA-256 over the hashes of the rows in order, however many files hold them."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    h = hashlib.sha256()
    for r in df.select(*order, row.alias("__h")).orderBy(*order).select("__h").toLocalIterator():
        h.update(r[0].encode())
    return h.hexdigest()
