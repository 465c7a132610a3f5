"""Dense vectors and scores, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_cosine(a: Column, b: Column) -> Column:
    """0 for null, empty, zero and vectors of different length."""
    norm = dense_dot(a, a) * dense_dot(b, b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, dense_dot(a, b) / F.sqrt(norm)).otherwise(0.0)


def normalize_dense(v: Column) -> Column:
    norm = F.sqrt(dense_dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def hash_slot(token: Column, dimensions: int) -> Column:
    """The place of a token in a hashed vector: the first four bytes of its SHA-256."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")


def hash_sign(token: Column) -> Column:
    """1 where the fifth byte is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 10, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


#: The parts of the dense and the sparse score in the score of a match.
DENSE, SPARSE = 0.84, 0.16


def combined(dense: Column, sparse: Column) -> Column:
    """Both at least 0; the sparse score alone where the dense one says nothing."""
    d, s = F.greatest(F.lit(0.0), dense), F.greatest(F.lit(0.0), sparse)
    return F.when(d > 0, d * DENSE + s * SPARSE).otherwise(s)


def fused(direct: Column, by_probe: Column, recency: Column) -> Column:
    return F.when(direct + by_probe > 0, direct * 0.72 + by_probe * 0.82 + recency * 0.03).otherwise(0.0)


def link_score(dense: Column, sparse: Column) -> Column:
    """The sparse score only where the dense one is exactly 0; a negative one stays negative."""
    return F.when(dense != 0, dense).otherwise(sparse)
