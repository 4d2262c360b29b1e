"""Embedding of texts: a provider is loaded once in a task and sees batches of distinct texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A model that turns texts into rows of a matrix, and what loads it; loading happens in the worker.
Encode = Callable[[Sequence[str]], np.ndarray]
Load = Callable[[], Encode]


def hashed(dimensions: int = 16) -> Encode:
    """A stand-in that needs no model: counts of code points by their remainder."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            np.add.at(row, [ord(c) % dimensions for c in text], 1.0)
        return out

    return encode


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def embedded(df: DataFrame, text: str, load: Load = hashed, name: str = "vector", normalise: bool = True, batch: int = 256) -> DataFrame:
    """df with `name`, the text's vector, null for a null text.

    Each distinct text is encoded once, in batches of at most `batch`, and joined back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for table in batches:
            for start in range(0, table.num_rows, batch):
                texts = table.column(0).slice(start, batch)
                rows = np.asarray(encode(texts.to_pylist()), dtype=np.float64)
                rows = normalised(rows) if normalise else rows
                yield pa.record_batch([texts, pa.array(rows.tolist(), pa.list_(pa.float64()))], ["__t", name])

    schema = T.StructType([T.StructField("__t", T.StringType()), T.StructField(name, T.ArrayType(T.DoubleType()))])
    vectors = df.select(F.col(text).alias("__t")).where("__t is not null").distinct().mapInArrow(run, schema)
    return df.join(vectors, F.col(text) == F.col("__t"), "left").drop("__t")
