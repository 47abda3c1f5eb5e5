"""Integer vectors: quantised rows, exact inner products and ordered picks in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers up to here are exact in double precision, so that products may use the fast routines.
EXACT = 1 << 53
LONGS = np.iinfo(np.int64)


def finite(vector: str) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    x = F.col(vector)
    each = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.isNotNull() & F.coalesce(each, F.lit(False))


def quantised(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component in double precision; beyond a long, the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def lengths(rows: DataFrame) -> dict[int, int]:
    """Number of rows by length of ``v``.

    N different lengths need N * N / 2 components in all, so the lengths of any table that can
    be stored fit on the driver; nearly always there is one.
    """
    return {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}


def matrix(column, dim: int) -> np.ndarray:
    """The rows of an Arrow list column, all of length ``dim``."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def largest(x: np.ndarray) -> int:
    """Largest magnitude, exact also for the least long."""
    return max(-int(x.min()), int(x.max())) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: longs, or Python integers where longs could overflow."""
    reach = largest(a) * largest(b) * max(1, a.shape[1])
    if reach < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach <= LONGS.max:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)


def to_long(x: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond a long become the nearest one."""
    if x.dtype != object:
        return x.astype(np.int64)
    return np.array([min(max(int(v), LONGS.min), LONGS.max) for v in x], np.int64)


def firsts(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of the ``k`` highest allowed scores of every row, best first.

    Ties go to the smaller column: callers keep columns in the order of ids.
    """
    rows, n = scores.shape
    if not rows or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if scores.dtype == object or largest(scores) >= LONGS.max // (n + 1) - 1:
        picked = [sorted(np.nonzero(allowed[r])[0], key=lambda c: (-scores[r, c], c))[:k] for r in range(rows)]
        return (
            np.repeat(np.arange(rows), [len(p) for p in picked]),
            np.array([c for p in picked for c in p], np.int64),
        )
    key = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), LONGS.min)
    if n > k:
        some = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        some = np.broadcast_to(np.arange(n), (rows, n))
    value = np.take_along_axis(key, some, 1)
    order = np.argsort(value, axis=1)[:, ::-1]
    some, value = np.take_along_axis(some, order, 1), np.take_along_axis(value, order, 1)
    row, place = np.nonzero(value > LONGS.min)
    return row, some[row, place]
