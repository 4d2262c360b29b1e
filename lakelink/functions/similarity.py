"""String and vector similarity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with one machine-word operation for each character (bit vectors)."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def indel(a: str, b: str) -> float:
    """200 LCS / (|a| + |b|); 100 for two empty strings."""
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.arrow_udf(T.DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Normalised Indel similarity, 0 to 100; null if a side is null."""
    return pa.array([None if x is None or y is None else indel(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def best_ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    """For each token of a, the best Indel ratio over the tokens of b (0 if b is empty)."""
    return pa.array([None if x is None or y is None else [max((indel(s, t) for t in y), default=0.0) for s in x] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.float64()))


def token_set_score(a: Column, b: Column, threshold: float | Column) -> Column:
    """Share of the larger set's size that finds a partner of at least the threshold, in per cent."""
    best = best_ratios(a, b)
    n = F.size(F.filter(best, lambda x: x >= threshold))
    return F.try_divide(n * 100.0, F.greatest(F.size(a), F.size(b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
