"""Near-duplicate vectors by an index of pivots with exact angular bounds."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweek.llm.components import connected_components, spanning_forest
from marketweek.llm.storage import ship, staged

COSINE = 0.9
#: Candidates for pivots are a sample of 4 times the root of the number of vectors, within these bounds.
MIN_PIVOTS, MAX_PIVOTS = 64, 16384
#: Vectors of a block: so many at least, at most, and bytes of its vectors in double precision.
BLOCK, MAX_BLOCK, BLOCK_BYTES = 1024, 8192, 1 << 26
#: Blocks wanted of a large table, and what rounding may add to a bound.
BLOCKS, ROUNDING = 32, 1e-9


def valid(vector: str):
    """Whether a vector can link: not null, all components finite, not zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def classes(rows: DataFrame) -> DataFrame:
    """Equal vectors as one row: ``(rep, copies, v)``; the smallest id stands for all."""
    return rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def unit(x: np.ndarray) -> np.ndarray:
    # Scale before squaring, so that extreme components neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unpacked(column, dim: int) -> np.ndarray:
    """Unit vectors of packed rows."""
    return unit(np.frombuffer(b"".join(column)).reshape(-1, dim))


def leaders(sample: np.ndarray, cosine: float) -> np.ndarray:
    """Vectors of the sample that are further apart than twice the angle of a link.

    Nearer pivots separate no vectors by ``reached``, so a crowded place gets few pivots. They
    are in the order of a chain of neighbours.
    """
    apart = 2 * cosine * cosine - 1 if cosine > 0 else -1.0
    chosen = np.zeros((0, sample.shape[1]))
    for x in sample:
        if not len(chosen) or (chosen @ x).max() < apart:
            chosen = np.vstack([chosen, x])
    left, order = np.ones(len(chosen), bool), [0]
    left[0] = False
    while left.any():
        near = np.where(left, chosen @ chosen[order[-1]], -2)
        order.append(int(np.argmax(near)))
        left[order[-1]] = False
    return chosen[order]


def cells(table: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(cell, near, rep, copies, v)``: each vector, packed, with its nearest pivot and the
    cosine between them."""
    dim = pivots.shape[1]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for lo in range(0, len(frame), 4096):
                part = frame.iloc[lo : lo + 4096]
                v = np.array([np.asarray(x, np.float64) for x in part["v"]]).reshape(-1, dim)
                near = unit(v) @ pivots.T
                home = near.argmax(axis=1)
                yield pd.DataFrame({
                    "cell": home.astype(np.int32), "near": near[np.arange(len(part)), home],
                    "rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "v": [x.tobytes() for x in v],
                })

    return table.mapInPandas(run, "cell int, near double, rep long, copies long, v binary")


def numbered(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: large cells are split, small neighbours
    share one."""
    first, count, at, fill = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for k, n in enumerate(sizes):
        if fill and fill + n > block:
            at, fill = at + 1, 0
        count[k], first[k] = max(1, -(-n // block)), at
        if count[k] > 1:
            at, fill = at + count[k], 0
        else:
            fill += n
    return first, count


def reached(near: np.ndarray, home: np.ndarray, pivots: np.ndarray, radius: np.ndarray, cosine: float) -> np.ndarray:
    """Which cells may hold a vector within the angle of a link, by row and cell.

    A vector is further than the angle from all of a cell if it is further from the plane
    between its own pivot and the cell's, or further from the cell's pivot than the angle and
    the cell's radius together. No link crosses such a bound, whatever the pivots.
    """
    angle = np.arccos(np.clip(cosine, -1, 1))
    out = np.arccos(np.clip(near, -1, 1)) <= radius + angle + ROUNDING ** 0.5
    if cosine > 0:
        own = near[np.arange(len(near)), home]
        wide = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[home]
        out &= own[:, None] - near <= np.sin(angle) * wide + ROUNDING
    out[np.arange(len(near)), home] = True
    return out


def dealt(rows: DataFrame, pivots: np.ndarray, sizes: np.ndarray, radius: np.ndarray, block: int, cosine: float) -> DataFrame:
    """``(i, j, block, rep, copies, v)``: each vector once for every block that it may link with."""
    dim = pivots.shape[1]
    first, count = numbered(sizes, block)
    ends = first + count
    blocks = int(ends.max())

    def run(frames):
        import pandas as pd

        for frame in frames:
            for lo in range(0, len(frame), 1024):
                part = frame.iloc[lo : lo + 1024]
                home, rep = part["cell"].to_numpy(), part["rep"].to_numpy()
                to = reached(unpacked(part["v"], dim) @ pivots.T, home, pivots, radius, cosine) & (sizes > 0)
                # Sums of +1 at the first block of a reached cell and -1 after its last.
                steps = np.zeros((len(part), blocks + 1), np.int64)
                row, cell = np.nonzero(to)
                np.add.at(steps, (row, first[cell]), 1)
                np.add.at(steps, (row, ends[cell]), -1)
                row, other = np.nonzero(np.cumsum(steps, axis=1)[:, :-1])
                spread = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
                own = (first[home] + spread % count[home])[row]
                v = part["v"].to_numpy()
                yield pd.DataFrame({
                    "i": np.minimum(own, other).astype(np.int32), "j": np.maximum(own, other).astype(np.int32),
                    "block": own.astype(np.int32), "rep": rep[row], "copies": part["copies"].to_numpy()[row], "v": v[row],
                })

    return rows.mapInPandas(run, "i int, j int, block int, rep long, copies long, v binary")


def compared(frame, cosine: float, dim: int):
    """Links of one pair of blocks: link counts by row and a spanning forest.

    A vector has one block, so no pair of vectors meets in two pairs of blocks.
    """
    import pandas as pd

    i, j = (int(frame[c].iloc[0]) for c in ("i", "j"))
    a = frame["block"].to_numpy() == i
    first, second = frame[a], frame if i == j else frame[~a]
    if not len(first) or not len(second):
        return pd.DataFrame({"rep": [], "links": [], "other": []})
    x, y = unpacked(first["v"], dim), unpacked(second["v"], dim)
    ra, rb = first["rep"].to_numpy(), second["rep"].to_numpy()
    ca, cb = first["copies"].to_numpy(), second["copies"].to_numpy()
    left, right, pairs = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    for lo in range(0, len(x), BLOCK):
        part = slice(lo, lo + BLOCK)
        link = x[part] @ y.T >= cosine
        if i == j:
            link &= ra[part, None] < rb[None, :]
        p, q = np.nonzero(link)
        left[part] += np.bincount(p, cb[q], len(left[part])).astype(np.int64)
        right += np.bincount(q, ca[part][p], len(y)).astype(np.int64)
        p = p + lo
        some = spanning_forest(p, q if i == j else q + len(x), len(x) if i == j else len(x) + len(y))
        pairs.append((p[some], q[some]))
    p, q = (np.concatenate(part) for part in zip(*pairs))
    forest = spanning_forest(p, q if i == j else q + len(x), len(x) if i == j else len(x) + len(y))
    some, other = left > 0, right > 0
    return pd.DataFrame({
        "rep": np.concatenate([ra[some], rb[other], ra[p[forest]]]),
        "links": np.concatenate([left[some], right[other], np.zeros(len(forest))]).astype(np.int64),
        "other": np.concatenate([ra[some], rb[other], rb[q[forest]]]),
    })


def linked(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(rep, links, other)``: partial link counts, and the edges of a spanning forest
    (``links`` 0) of the distinct vectors of ``table``."""
    n = table.count()
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(4 * math.sqrt(n))))
    sample = table.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("v").collect()
    if not sample:
        return table.sparkSession.createDataFrame([], "rep long, links long, other long")
    pivots = leaders(unit(np.array([r.v for r in sample], np.float64)), cosine)
    dim = pivots.shape[1]
    rows = staged(cells(table, pivots), "cells")
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    # At most one row a pivot.
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect():
        sizes[r.cell], radius[r.cell] = r.n, math.acos(max(-1.0, min(1.0, r.near)))
    block = max(1, min(max(BLOCK, min(MAX_BLOCK, n // BLOCKS)), BLOCK_BYTES // (8 * dim)))
    return dealt(rows, pivots, sizes, radius, block, cosine).groupBy("i", "j").applyInPandas(
        lambda frame: compared(frame, cosine, dim), "rep long, links long, other long"
    )


def near_vectors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id",
                 cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``df``.

    Equal vectors are one entry of the index; their copies count as links. Vectors are dealt
    into blocks by their nearest pivots, a bounded sample of the vectors, and every pair of
    blocks is a task of bounded size that gives back counts and a forest instead of pairs. A
    vector stays away from a block only if an angular bound rules out a link, so every pair
    with a cosine of ``cosine`` or more in double precision is found, at any size and however
    crowded a place is. Where no bound separates the vectors all pairs are compared.

    Vectors link only with those of their own length; each length is an index of its own. Null,
    zero and non-finite vectors, and rows without id link with nothing: no links, a component
    of their own, kept (rows without id have none and aren't kept). Repeated rows link with each other; an empty table gives no rows; other
    columns are ignored.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & valid("v"))
    # Minus zero equals zero but would group apart.
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float")))
    table = staged(classes(good), "vectors")
    lengths = table.groupBy(F.size("v").alias("n")).count().where("count > 1").select("n")
    parts = [linked(table.where(F.size("v") == r.n), cosine) for r in lengths.toLocalIterator()]
    none = df.sparkSession.createDataFrame([], "rep long, links long, other long")
    found = staged(reduce(DataFrame.union, parts, none), "links")
    counts = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("links = 0").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = (
        table.join(counts, "rep", "left")
        .join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(
            "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    one = rows.withColumn(
        "v", F.when(F.col("vec_id").isNotNull() & valid("v"), F.transform("v", lambda x: x + F.lit(0).cast("float")))
    )
    return one.join(named, "v", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )
