"""Pack documents along a Hilbert curve through their hashed vectors."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweek.llm.bpe import batches, encoder
from marketweek.llm.storage import ship, staged

SEQUENCE = 2048
END_ID = 1
DIMENSIONS, BITS = 4, 15
BUCKETS = 4096
TEXT_CHARS = 4_000_000


def projection(vocabulary: int, seed: int = 11) -> np.ndarray:
    """What each id adds to a document's coordinates.

    An id falls into one of ``BUCKETS`` signed buckets; a fixed Gaussian matrix projects the
    bucket vector to ``DIMENSIONS`` coordinates. Both steps together are one row per id.
    """
    mixed = (np.arange(vocabulary, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
    sign = np.where((mixed >> np.uint64(39)) & np.uint64(1), 1.0, -1.0)
    gauss = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    return (gauss[bucket] * sign[:, None]).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each integer cell (rows, dimensions) on the Hilbert curve.

    Two sweeps over the bits turn cell coordinates into the transposed Hilbert index
    (Skilling 2004, public); the bits are then interleaved into one long.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document: mean id vector, squashed into the cells of a fixed grid."""
    sums = np.zeros((len(counts), table.shape[1]))
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    if len(starts):
        for d in range(table.shape[1]):
            sums[some, d] = np.add.reduceat(table[:, d][ids].astype(np.float64), starts)
    z = sums / np.maximum(counts, 1)[:, None]
    cells = (4 * z / (1 + 4 * np.abs(z)) + 1) / 2 * (1 << BITS)
    return hilbert_key(np.clip(cells.astype(np.int64), 0, (1 << BITS) - 1))


def tokenised(docs: DataFrame, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(row_id, doc_id, key, n_tokens, ids)``: ids as little-endian 16-bit, the end id last.

    ``row_id`` tells repeated documents apart; it is only fixed once the table is written.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )

    def encode(frames):
        codes = encoder()
        table = projection(1 << 16)
        for row_id, doc_id, texts in batches(frames, ["row_id", "doc_id", "text"], "text", TEXT_CHARS):
            ids, counts = codes.encode(texts)
            keys = curve_keys(ids, counts, table)
            cuts = np.cumsum(counts)
            # Insert the end id behind each document.
            whole = np.insert(ids, cuts, np.uint16(end_id)).astype("<u2")
            ends = np.cumsum(counts + 1)
            offsets = pa.py_buffer(np.concatenate([[0], ends * 2]).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(
                pa.binary(), len(counts), [None, offsets, pa.py_buffer(whole.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_id, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(keys),
                 pa.array(counts + 1), packed],
                names=["row_id", "doc_id", "key", "n_tokens", "ids"],
            )

    return rows.mapInArrow(encode, "row_id long, doc_id long, key long, n_tokens long, ids binary")


def curve_starts(tokens: DataFrame) -> DataFrame:
    """``(row_id, first)``: ids before each document along the whole curve.

    The order is (key, doc_id, row_id), so a curve place shared by a third of all documents
    still spreads over many ranges. Each range adds up its own documents; the totals of the
    ranges, one row a partition, are added up across ranges.
    """
    ordered = (
        tokens.select("row_id", "doc_id", "key", "n_tokens")
        .repartitionByRange("key", "doc_id", "row_id")
        .sortWithinPartitions("key", "doc_id", "row_id")
        .select("row_id", "n_tokens", F.spark_partition_id().alias("part"))
    )

    def running(frames):
        before = 0
        for frame in frames:
            ends = before + frame["n_tokens"].cumsum()
            yield frame.assign(inside=ends - frame["n_tokens"])
            before = int(ends.iloc[-1]) if len(ends) else before

    places = staged(
        ordered.mapInPandas(running, "row_id long, n_tokens long, part int, inside long"), "places"
    )
    ranges = places.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    behind = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("total").over(behind), F.lit(0)).alias("before"))
    # One row a partition of the line above: the number of partitions bounds the broadcast.
    return places.join(F.broadcast(ranges), "part").select(
        "row_id", (F.col("before") + F.col("inside")).alias("first")
    )


def pack(docs: DataFrame, text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Cut the curve of all documents into sequences of ``sequence`` ids; one row per piece.

    Every sequence but the last is full, so padding is below one sequence for the whole
    corpus. A null or empty text is one piece holding the end id; repeated rows, also with
    one ``doc_id``, are packed once each; a null ``doc_id`` is kept; an empty table gives no
    pieces. Further columns of ``docs`` are ignored.

    The ids are written once with the curve key; only keys and counts are sorted, and the
    ids move once, to meet their place.
    """
    import pyarrow as pa

    tokens = staged(tokenised(docs, text), "tokens")
    placed = tokens.select("row_id", "doc_id", "n_tokens", "ids").join(curve_starts(tokens).hint("merge"), "row_id")

    def cut(frames):
        for frame in frames:
            out = [[] for _ in range(7)]
            for doc_id, n, first, buffer in zip(
                *(frame.column(c).to_pylist() for c in ("doc_id", "n_tokens", "first", "ids"))
            ):
                ids = np.frombuffer(buffer, "<u2").astype("<u4")
                start = 0
                while start < n:
                    at = first + start
                    length = min(n - start, sequence - at % sequence)
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(out, (doc_id, start, length, crc, n, at // sequence, at % sequence)):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.select("doc_id", "n_tokens", "first", "ids").mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )
