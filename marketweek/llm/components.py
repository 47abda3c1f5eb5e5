"""Connected components by alternating star contraction on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweek.llm.storage import staged

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """Map every node of ``edges(a, b)`` to the smallest node it reaches: ``(node, component)``.

    Every round rewires each node's larger neighbours, then its smaller ones, to the smallest
    node it sees. The number of edges never grows, minima combine before every shuffle, and
    the number of rounds grows with the logarithm of the longest path. Nothing is collected
    but two sums a round, which stop the loop once the edges stay as they are. Loops, repeated
    and reversed edges and null ends are harmless; an empty table gives an empty result. Nodes
    without an edge to another node are not returned.
    """
    now = staged(_oriented(edges).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        large = _star(now.union(now.select("v", "u").toDF("u", "v")), larger=True)
        now = staged(_star(large, larger=False), "edges")
        # The smaller ends only ever sink, so equal sums mean equal edges.
        after = now.agg(
            F.count("*"), F.sum(F.col("v").cast("decimal(20,0)")), F.sum(F.col("u").cast("decimal(20,0)"))
        ).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    """``u`` is the larger end."""
    return edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours ``v`` of each ``u`` to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if larger:
        least = least.select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return _oriented(out).distinct()


def spanning_forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Indices of pairs ``(i, j)`` over ``n`` nodes that connect what all pairs connect.

    At most ``n - 1`` are chosen: in every round each tree takes one pair to the smallest tree
    it touches.
    """
    label, chosen = np.arange(n), []
    rest = np.arange(len(i))
    while True:
        high = np.maximum(label[i[rest]], label[j[rest]])
        low = np.minimum(label[i[rest]], label[j[rest]])
        apart = high != low
        rest, high, low = rest[apart], high[apart], low[apart]
        if not len(rest):
            return np.concatenate(chosen) if chosen else rest
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], np.diff(high[order]) != 0])]
        chosen.append(rest[first])
        parent = np.arange(n)
        parent[high[first]] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
