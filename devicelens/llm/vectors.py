"""Whole-number vectors, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and holds finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """The components times ``scale``, floored."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))


def extent(rows: DataFrame, ints: str, most_bits: int) -> tuple[int, int, int]:
    """(rows, longest vector, greatest size of a component); refuses components that overflow the 64-bit results.

    The squared size times the length must stay below ``2 ** most_bits``.
    """
    size = F.aggregate(ints, F.lit(0).cast("long"), lambda most, x: F.greatest(most, F.abs(x)))
    n, length, most = rows.select(F.size(ints).alias("n"), size.alias("most")).agg(
        F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0))).first()
    if max(length, 1) * (2 * most) ** 2 >= 2**most_bits or most >= 2**31:
        raise ValueError(f"components of size {most} in vectors of length {length} don't fit 64-bit results")
    return n, length, most


def padded(ints: Column, length: int) -> Column:
    """The vector with zeros behind it up to ``length``."""
    return F.concat(ints, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(ints)))


def matrix(column, length: int) -> np.ndarray:
    """The vectors of an Arrow list column of equal lengths, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def blobs(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def unblob(column, dtype, *shape: int) -> np.ndarray:
    """Rows of bytes as one array of the given shape per row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)
