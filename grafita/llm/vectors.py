"""Vectors in tables: which take part, and as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, every component finite, not all zero."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def dimension(vectors: DataFrame) -> tuple[int, int, int]:
    """The commonest length of the usable vectors (of equally common ones the larger), how many have it, and how many have another."""
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count()
    top = sizes.agg(F.max(F.struct("count", "d")).alias("top"), F.sum("count").alias("n")).first()
    return (int(top.top.d), int(top.top["count"]), int(top.n - top.top["count"])) if top.n else (0, 0, 0)
