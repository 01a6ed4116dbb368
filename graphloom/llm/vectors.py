"""What the operators on embeddings share: which vectors take part, their matrices, cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vector = F.col(column)
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length (the smallest of several); vectors of others take no part."""
    row = vectors.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row.n if row else 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit rows x and y, pair by pair: the one formula that decides links."""
    return (x * y).sum(axis=1)


def close(x: np.ndarray, y: np.ndarray, least: float, step: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, which rows of y have a cosine of at least ``least``) for ``step`` rows of x at a time; unit rows.

    A product of matrices may differ from :func:`cosines` in the last digits, so entries
    next to the threshold are judged by that.
    """
    for at in range(0, len(x), step):
        found = x[at : at + step] @ y.T
        linked = found >= least
        i, j = np.nonzero(np.abs(found - least) < 1e-9)
        if len(i):
            linked[i, j] = cosines(x[at + i], y[j]) >= least
        yield at, linked
