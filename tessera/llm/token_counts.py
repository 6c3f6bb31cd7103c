"""Token counts by separator scan (op 7): document lengths from flat token files that have no index.

A flat token file is a run of little-endian token ids, each document followed by an end-of-document id. Files are read
as blocks of fixed size that cut documents anywhere. Per block, one vectorised search finds the separators and yields
the tokens before the first, between neighbours, and after the last. A document that crosses blocks gets what earlier
blocks carried over, by a segmented prefix scan in two levels over one small row a block: windows run within groups of
``GROUP`` blocks, then over the groups of a file, so no file is gathered in one task.

``pack`` writes such files from texts, with the ids of the documents whose separators lie in a block beside it (an
order, no lengths). Token ids need 16 or 32 bits, by the size of the vocabulary; the separator never occurs within a
document, since special tokens in texts are encoded as ordinary text.

Defined results: null and empty text count 0 tokens; repeated rows give a row each; tokens after the last separator of a
file form a last document with ``terminated`` false; blocks of a file must be numbered without gaps, and an empty block
is allowed; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import table

#: Tokens a block, blocks a group, and neighbouring blocks that a task reads of one file.
BLOCK = 1 << 17
GROUP = 1024
RANGE_BLOCKS = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@cache
def _tokenizer(ranks: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, block: int = BLOCK) -> tuple[DataFrame, int, str]:
    """Token files of ``docs``: rows (file, block, data, ids), the separator's id and the numpy type of a token.

    A task writes one file. Rows are to be written as a table before use (``counts`` does), since the numbering of
    files is that of the tasks.
    """
    import public_tokenizers

    with open(vocabulary or default_vocabulary(), "rb") as f:
        ranks = f.read()
    pattern = public_tokenizers.PATTERN
    eod = ranks.count(b"\n") + (not ranks.endswith(b"\n"))
    dtype = "<u2" if eod < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokenizer(ranks, pattern)
        file = TaskContext.get().partitionId()
        number, held, size = 0, [], 0
        ends: list[tuple[int, int | None]] = []  # separators so far in what is held: (place, id)

        def cut(tokens: np.ndarray, upto: int) -> pa.RecordBatch:
            nonlocal number, ends
            ids = [d for p, d in ends if p < upto]
            ends = [(p - upto, d) for p, d in ends if p >= upto]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number - 1], pa.int64()), pa.array([tokens[:upto].tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "data", "ids"])

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                tokens = enc.encode_ordinary(t.as_py() or "")
                tokens.append(eod)
                held.append(np.array(tokens, dtype))
                size += len(tokens)
                ends.append((size - 1, d.as_py()))
                while size >= block:
                    flat = np.concatenate(held)
                    yield cut(flat, block)
                    held, size = [flat[block:]], size - block
        if size:
            yield cut(np.concatenate(held), size)

    cols = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    return cols.mapInArrow(run, "file int, block long, data binary, ids array<long>"), eod, dtype


def read_files(spark: SparkSession, path: str, block_bytes: int = BLOCK * 4) -> DataFrame:
    """Blocks (file, block, data, ids null) of flat token files of any size, each block read by its byte range.

    ``block_bytes`` is a multiple of the bytes of a token. Spark lists the files and their lengths without reading them;
    the ranges are dealt over the tasks, so that a file isn't bound to one. Paths are those that pyarrow opens: shared
    folders, HDFS and object stores. An empty file is one empty block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        try:
            for batch in batches:
                for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if file != name:
                        if held is not None:
                            held.close()
                        name, held = file, _opened(file)
                    held.seek(block * block_bytes)
                    data = held.read(block_bytes)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([None], pa.list_(pa.int64()))], ["file", "block", "data", "ids"])
        finally:
            if held is not None:
                held.close()

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / block_bytes).cast("long")
    ranges = files.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    # runs of neighbouring blocks stay in one task
    dealt = ranges.repartition("file", F.floor(F.col("block") / RANGE_BLOCKS)).sortWithinPartitions("file", "block")
    return dealt.mapInArrow(run, "file string, block long, data binary, ids array<long>")


def _opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def scan(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal within its block, block, doc_id, n_tokens, terminated) of each document that ends in ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, tails, seps = [], [], []
            for x in batch.column(2):
                tokens = np.frombuffer(x.as_buffer() or b"", dtype)
                at = np.flatnonzero(tokens == eod)
                seps.append(len(at))
                counts.append(np.diff(at, prepend=-1) - 1)
                tails.append(len(tokens) - (int(at[-1]) + 1 if len(at) else 0))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *seps]), pa.int32()), pa.array(np.concatenate(counts) if counts else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), lists, pa.array(tails, pa.int64())], ["file", "block", "ids", "counts", "tail"])

    file_type = blocks.schema["file"].dataType.simpleString()
    s = blocks.select("file", "block", "data", "ids").mapInArrow(run, f"file {file_type}, block long, ids array<long>, counts array<long>, tail long")
    s = s.withColumn("g", F.floor(F.col("block") / GROUP)).withColumn("n", F.size("counts"))

    def carried(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
        """Adds what rows before this one carry over: tails since the last row with a separator; and whether one had any."""
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(f"{name}_last", F.max(F.when(F.col("n") > 0, F.col(order))).over(before))
        rows = rows.withColumn("__sum", F.coalesce(F.sum("tail").over(before), F.lit(0)))  # all tails before this row
        upto = F.max(F.when(F.col("n") > 0, F.struct(F.col(order), F.col("__sum").alias("v")))).over(before)["v"]
        return rows.withColumn(f"{name}_in", F.col("__sum") - F.coalesce(upto, F.lit(0))).drop("__sum")

    small = carried(s.select("file", "g", "block", "n", "tail"), ["file", "g"], "block", "own")
    groups = small.groupBy("file", "g").agg(
        F.sum("n").alias("n"),
        F.max_by(F.col("tail") + F.when(F.col("n") > 0, 0).otherwise(F.col("own_in")), "block").alias("tail"),
    )
    groups = carried(groups, ["file"], "g", "group").select("file", "g", "group_in", F.col("tail").alias("group_tail"), F.col("n").alias("group_n"))
    carry = small.join(groups, ["file", "g"]).select("file", "block", (F.col("own_in") + F.when(F.col("own_last").isNull(), F.col("group_in")).otherwise(0)).alias("carry"))
    found = s.join(carry, ["file", "block"]).select(
        "file",
        "block",
        F.posexplode(F.arrays_zip(F.coalesce("ids", F.transform("counts", lambda x: F.lit(None).cast("long"))).alias("ids"), F.transform("counts", lambda x, i: x + F.when(i == 0, F.col("carry")).otherwise(0)).alias("c"))).alias("ordinal", "x"),
    )
    ended = found.select("file", "block", "ordinal", F.col("x")["ids"].alias("doc_id"), F.col("x")["c"].alias("n_tokens"), F.lit(True).alias("terminated"))
    over = groups.groupBy("file").agg(F.max_by(F.col("group_tail") + F.when(F.col("group_n") > 0, 0).otherwise(F.col("group_in")), "g").alias("n_tokens"), F.max("g").alias("g"))
    rest = over.filter("n_tokens > 0").select("file", F.lit(None).cast("long").alias("block"), F.lit(0).alias("ordinal"), F.lit(None).cast("long").alias("doc_id"), "n_tokens", F.lit(False).alias("terminated"))
    return ended.unionByName(rest)


def counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of all documents, by packing them into token files and scanning those."""
    blocks, eod, dtype = pack(docs, id_col, text, vocabulary, block)
    return scan(table(blocks, "tokens"), eod, dtype).filter("terminated").select("doc_id", "n_tokens")
