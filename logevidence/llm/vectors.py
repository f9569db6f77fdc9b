"""Vectors as whole numbers, and their rows grouped by length inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(vector: str = "embedding") -> Column:
    """floor(256 * c) of every component as long (limited to the range of long)."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * 256).cast("long"))


def complete(vector: str = "embedding") -> Column:
    """True for a vector that is not null and has neither null nor non-finite components; never null."""
    fine = F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length that occurs: the length, the rows of that length, and their components as a matrix of int64."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.append(0, np.cumsum(size))
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield int(length), rows, flat[starts[rows][:, None] + np.arange(length)].astype(np.int64, copy=False)


def exact(x: np.ndarray, bound: int) -> np.ndarray:
    """The same numbers as Python integers where ``bound``, the largest result to come, leaves the range of int64."""
    return x if bound < 1 << 63 else x.astype(object)


def largest(x: np.ndarray) -> int:
    """The largest absolute value as a Python integer; 0 for an empty array."""
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
