"""Whole-number vectors for exact distances and inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components whose whole number reaches this are an error: products and distances would not fit 64 bits.
LIMIT = 1 << 26
#: Whole numbers below this are exact in double precision.
EXACT = 1 << 53


def is_sound(embedding: str, dim: int | None = None) -> Column:
    """Whether a vector, of dim components if given, has neither null nor non-finite ones; false for null."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite if dim is None else finite & (F.size(embedding) == dim), F.lit(False))


def quantised(embedding: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component x as double, in an array of int."""
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(whole, lambda x: F.abs(x) < LIMIT)
    said = F.raise_error(F.lit(f"a vector's component times {scale} reaches {LIMIT}"))
    return F.when(fits, F.transform(whole, lambda x: x.cast("int"))).otherwise(said.cast("array<int>"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of an Arrow column, all of dim components, as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b: by one matrix product in double precision where that is exact, else in 64 bits."""
    bound = a.shape[1] * largest(a) * largest(b)
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 1 << 62:
        raise OverflowError("inner products of these vectors don't fit 64 bits")
    return a @ b.T
