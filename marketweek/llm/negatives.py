"""Hard negatives by packed products: several candidates in the fields of one wide integer."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweek.llm.integers import EXACT, LONGS, finite, firsts, lengths, matrix, quantised, to_long
from marketweek.llm.storage import ship, staged

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies between these shares of the positive's, in percent.
LOW, HIGH = 30, 90
#: Candidates of a block, and anchors that meet a block at once.
MIN_BLOCK, MAX_BLOCK, SLICE = 4096, 65536, 65536
#: Bytes of a block, and scores held at once.
BLOCK_BYTES, CELLS = 1 << 25, 1 << 21
#: Bits of a wide integer where no double holds two fields.
WIDE = 2048

PICKED = "a long, anchor_id long, other_id long, score long"
CHOSEN = "a long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


class Packed:
    """Candidates packed into fields of wide integers, for exact products with anchors.

    Components of both sides are biased to start at zero, so that a field only ever grows, up
    to a bound that fits it. One multiplication of an anchor's component serves all fields, and
    the bias comes off after unpacking: ``sum (a - p)(c - q) = sum a c - p sum c - q sum a +
    n p q``. Wide integers are doubles where two or more fields fit their 53 exact bits, else
    Python's integers of about ``WIDE`` bits.
    """

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        self.n, dim = len(candidates), candidates.shape[1]
        self.low = int(candidates.min()) if candidates.size else 0
        self.anchor_low = int(anchors.min()) if anchors.size else 0
        high = (int(candidates.max()) if candidates.size else 0) - self.low
        anchor_high = (int(anchors.max()) if anchors.size else 0) - self.anchor_low
        self.bits = max(1, (dim * high * anchor_high).bit_length())
        self.doubles = 2 * self.bits <= EXACT.bit_length() - 1
        self.fields = max(1, (EXACT.bit_length() - 1 if self.doubles else WIDE) // self.bits)
        # Only biased sums that may leave a long need Python's integers to the end.
        reach = max(abs(self.low), abs(self.low + high)) * max(abs(self.anchor_low), abs(self.anchor_low + anchor_high))
        self.longs = self.bits < 62 and 4 * dim * max(reach, 1) < LONGS.max
        words = -(-self.n // self.fields)
        biased = np.zeros((words * self.fields, dim), object)
        biased = biased.astype(np.int64) if self.doubles else biased
        biased[: self.n] = candidates - self.low if self.doubles else candidates.astype(object) - self.low
        # Word w holds candidates w, w + words, w + 2 * words, ...
        biased = biased.reshape(self.fields, words, dim)
        wide = biased[0].copy()
        for f in range(1, self.fields):
            wide = wide + (biased[f] << (f * self.bits) if self.doubles else biased[f] * (1 << (f * self.bits)))
        self.wide = wide.astype(np.float64).T if self.doubles else wide.T
        self.sums = candidates.astype(np.int64 if self.longs else object).sum(axis=1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors and candidates, by row and column."""
        if self.doubles:
            total = ((anchors - self.anchor_low).astype(np.float64) @ self.wide).astype(np.int64)
        else:
            total = (anchors.astype(object) - self.anchor_low) @ self.wide
        mask = (1 << self.bits) - 1
        parts = [(total >> (f * self.bits)) & mask for f in range(self.fields)]
        kind = np.int64 if self.longs else object
        out = np.concatenate(parts, axis=1)[:, : self.n].astype(kind)
        own = anchors.astype(kind).sum(axis=1)
        return out + self.anchor_low * self.sums + (self.low * own)[:, None] - anchors.shape[1] * self.anchor_low * self.low


def blocks_of(counts: dict[int, int]) -> dict[int, int]:
    """Number of blocks of the candidates of each length."""
    n = sum(counts.values())
    size = max(MIN_BLOCK, min(MAX_BLOCK, n // 64))
    return {dim: math.ceil(c / max(1, min(size, BLOCK_BYTES // (8 * max(1, dim))))) for dim, c in counts.items()}


def taken(table) -> tuple:
    """Ids, labels and vectors of a block's candidates, in the order of ids."""
    table = table.sort_by("vec_id")
    dim = table.column("dim")[0].as_py()
    return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("v"), dim)


def parts_of(n: int, width: int):
    step = max(1, CELLS // max(1, width))
    return (slice(lo, lo + step) for lo in range(0, n, step))


def positives(candidates: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each anchor's label in each block."""

    def run(left, right):
        import pyarrow as pa

        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if left.num_rows and right.num_rows:
            ids, labels, v = taken(left)
            anchor, a = right.column("vec_id").to_numpy(), right.column("a").to_numpy()
            own, x = right.column("label").to_numpy(), matrix(right.column("v"), v.shape[1])
            packed = Packed(x, v)
            for part in parts_of(len(x), len(v)):
                score = packed.scores(x[part])
                allowed = (own[part][:, None] == labels) & (anchor[part][:, None] != ids)
                row, col = firsts(score, allowed, k)
                for values, more in zip(out, (a[part][row], anchor[part][row], ids[col], to_long(score[row, col]))):
                    values.append(more)
        return pa.table(dict(zip(("a", "anchor_id", "other_id", "score"), map(np.concatenate, out))))

    return candidates.groupBy("dim", "block", "slice").cogroup(anchors.groupBy("dim", "block", "slice")).applyInArrow(run, PICKED)


def negatives(candidates: DataFrame, anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """For each anchor and positive the ``k`` best candidates in range in each block."""

    def run(left, right):
        import pyarrow as pa

        out = [[np.zeros(0, np.int64)] for _ in range(7)]
        if left.num_rows and right.num_rows:
            ids, labels, v = taken(left)
            anchor, a = right.column("vec_id").to_numpy(), right.column("a").to_numpy()
            own, x = right.column("label").to_numpy(), matrix(right.column("v"), v.shape[1])
            found = right.column("positives").to_pylist()
            packed = Packed(x, v)
            for part in parts_of(len(x), len(v)):
                score = packed.scores(x[part])
                other = own[part][:, None] != labels
                mine = found[part]
                hundred = score * 100 if score.dtype == object or not score.size or np.abs(score).max() < LONGS.max // 100 else score.astype(object) * 100
                for place in range(max((len(p) for p in mine), default=0)):
                    some = np.flatnonzero([len(p) > place for p in mine])
                    positive = np.array([mine[r][place]["other_id"] for r in some], np.int64)
                    value = np.array([mine[r][place]["score"] for r in some], np.int64)
                    wide = value.astype(object) if hundred.dtype == object or np.abs(value).max() >= LONGS.max // 100 else value
                    h = hundred[some]
                    allowed = other[some] & (h >= (low * wide)[:, None]) & (h <= (high * wide)[:, None])
                    row, col = firsts(score[some], allowed.astype(bool), k)
                    r = some[row]
                    for values, more in zip(out, (
                        a[part][r], anchor[part][r], np.full(len(r), place), positive[row], value[row], ids[col],
                        to_long(score[r, col]),
                    )):
                        values.append(more)
        names = ("a", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")
        columns = dict(zip(names, map(np.concatenate, out)))
        return pa.table(columns | {"place": pa.array(columns["place"].astype(np.int32))})

    return candidates.groupBy("dim", "block", "slice").cogroup(anchors.groupBy("dim", "block", "slice")).applyInArrow(run, CHOSEN)


def by_length(values: dict[int, int]):
    """A column that gives each length's value: a chain of cases over the few lengths."""
    column = F.lit(None).cast("int")
    for dim, value in values.items():
        column = F.when(F.col("dim") == dim, F.lit(value)).otherwise(column)
    return column


def hard_negatives(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
                   every: int = 100, scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become ``floor(scale * x)`` and scores are exact integer inner products. Anchors
    are the rows whose id is divisible by ``every``; an anchor's positives are its
    ``n_positives`` best other rows of the same label. For each of them, the ``n_negatives``
    best rows of other labels whose score lies between ``low`` and ``high`` percent of the
    positive's follow, with their rank; ties go to the smaller id. A positive without such a
    row has none, as has every positive with a negative score.

    Candidates are dealt by a hash of their id into blocks of bounded size, whatever their
    labels, and every block meets all anchors, a bounded slice at a time: once for positives,
    once for negatives within the range that the positives set. Only the best of a block leave
    its task.

    Rows with a null id or label, a null vector, or null or non-finite components take no part.
    Vectors of different lengths are never compared. Rows that repeat id, label and vector
    count once; rows that share an id but differ are each candidates, and anchors of their own
    under the same id; a row with the anchor's id is never its positive. Components and scores
    beyond a long become the nearest long. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("v"))
    rows = rows.select("vec_id", "label", quantised("v", scale).alias("v")).distinct()
    table = staged(rows.withColumn("dim", F.size("v")), "labelled-vectors")
    counts = lengths(table)
    blocks = blocks_of(counts)
    anchors = staged(table.where(F.col("vec_id") % every == 0), "anchors")
    slices = max(1, math.ceil(anchors.count() / SLICE))
    key = F.xxhash64("vec_id", "label", "v")
    candidates = table.withColumn("block", F.pmod(key, by_length(blocks)).cast("int")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )
    anchors = anchors.withColumn("a", key).withColumn("slice", F.pmod(F.shiftright(key, 20), F.lit(slices)).cast("int"))
    blocks_for = F.explode(F.sequence(F.lit(0), by_length(blocks) - 1))
    best = positives(candidates, anchors.withColumn("block", blocks_for), n_positives)
    order = Window.partitionBy("a", "anchor_id").orderBy(F.desc("score"), "other_id")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    # At most n_positives entries an anchor.
    best = best.groupBy("a", "anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "other_id", "score"))).alias("positives")
    )
    best = staged(best.withColumnRenamed("anchor_id", "vec_id"), "positives")
    pairs = staged(anchors.join(best, ["a", "vec_id"]), "pairs").withColumn("block", blocks_for)
    chosen = negatives(candidates, pairs, n_negatives, low, high)
    order = Window.partitionBy("a", "anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        chosen.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n_negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
