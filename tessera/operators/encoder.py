"""Text encoders. Trained weights are not part of this package: a caller passes a function from texts to a matrix."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import passage_prompt, query_prompt


def encode(rows: DataFrame, text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> DataFrame:
    """Adds ``embedding``, L2-normalised. ``load`` runs once per Python worker and returns texts -> matrix."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts = part.fillna("").tolist()
            out: list[np.ndarray] = []
            for lo in range(0, len(texts), batch):
                m = np.asarray(model(texts[lo : lo + batch]), np.float64)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                out += list((m / np.where(norm > 0, norm, 1)).astype(np.float32))
            yield pd.Series([x.tolist() for x in out])

    return rows.withColumn("embedding", run(text))


def encode_items(items: DataFrame, load: Callable, batch: int = 32) -> DataFrame:
    return encode(items, passage_prompt("title", "params"), load, batch)


def encode_queries(queries: DataFrame, load: Callable, batch: int = 32) -> DataFrame:
    return encode(queries, query_prompt("search_query", "search_infm_params_text"), load, batch)


def hashed_words(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in without training: signed hashed word counts. For tests and dry runs only."""

    def load() -> Callable[[list[str]], np.ndarray]:
        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in re.findall(r"[^\W_]+", t.lower()):
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
            return out

        return model

    return load
