"""SimHash fingerprints and exact linking within a radius by covering masks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweek.llm.components import connected_components, spanning_forest
from marketweek.llm.storage import ship, staged

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Shingles hashed at once, and distinct fingerprints of one bucket compared at once.
BLOCK, BUCKET = 1 << 16, 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text.

    Words are separated by ASCII white space and A-Z count as a-z. A bit is set where over
    half of the shingle hashes, repeats included, have it; no word gives zero.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    one = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        hashes = np.fromiter(
            (one(joined[a:b], SEED) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())),
            "<u8", min(BLOCK, len(starts) - k),
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def body_of(text: str):
    """What tells the texts of rows that repeat a doc_id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, body, print)``: ``print`` holds the 64 bits as a signed long, ``body`` a hash
    of the text."""

    ship(docs.sparkSession)

    def run(frames):
        for frame in frames:
            prints = np.fromiter(map(fingerprint, frame["text"]), np.uint64, len(frame))
            yield frame[["doc_id", "body"]].assign(print=prints.view(np.int64))

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), body_of(text).alias("body"),
    )
    return rows.mapInPandas(run, "doc_id long, body long, print long")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``positions`` such that two words differing in at most ``radius`` of them
    agree under some mask.

    Every position gets a non-zero vector of ``radius + 1`` bits, in turn; a mask is a non-zero
    vector too and holds the positions whose vector has an odd overlap with it. The vectors of
    at most ``radius`` differing positions leave a non-zero vector orthogonal to all of them,
    and that one's mask holds none of these positions (Pagh 2016, public).
    """
    vectors = range(1, 1 << (radius + 1))
    given = {p: 1 + k % len(vectors) for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (given[p] & m).bit_count() % 2) for m in vectors]


def close_forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what a chain of close pairs connects among distinct ``values``.

    Fingerprints join the tree they are close to one by one, so at most one edge a value
    comes back, whatever the number of close pairs.
    """
    n = len(values)
    label = np.arange(n)
    a, b = [], []
    for i in range(1, n):
        close = np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= radius)
        if len(close):
            labels, first = np.unique(label[close], return_index=True)
            for k in first:
                a.append(int(close[k]))
                b.append(i)
            label[:i][np.isin(label[:i], labels)] = i
    return values[a] if a else values[:0], values[b] if b else values[:0]


def _bucket_rows(frames, bucket: int, second: bool):
    """Walk through rows sorted by (mask, masked bits): edges of small buckets, else the rows.

    A bucket larger than ``bucket`` goes on to the second covering; only as many rows are held
    as one bucket may have. At the second level only the bits outside both masks are free,
    which bounds a bucket's size, so each is linked here.
    """
    import pandas as pd

    held: list[np.ndarray] = []
    key, size, over = None, 0, False
    edges_a, edges_b, passed, passed_mask = [], [], [], []

    def close():
        """Link or pass on what is held."""
        if over:
            passed.extend(held)
            passed_mask.extend(np.full(len(v), key[0]) for v in held)
        elif size > 1:
            values = np.concatenate(held).view(np.uint64)
            a, b = neighbour_forest(values, free_bits(key[0], key[1])) if second else close_forest(values)
            edges_a.append(a.view(np.int64))
            edges_b.append(b.view(np.int64))

    def flush():
        n = sum(map(len, edges_a)), sum(map(len, passed))
        if any(n):
            yield pd.DataFrame({
                "kind": np.repeat(np.array([0, 1], np.int8), n),
                "a": np.concatenate([*edges_a, *passed]), "b": np.concatenate([*edges_b, *passed]),
                "mask": np.concatenate([np.zeros(n[0], np.int16), *passed_mask]).astype(np.int16),
            })
        for kept in (edges_a, edges_b, passed, passed_mask):
            kept.clear()

    for frame in frames:
        if not len(frame):
            continue
        columns = [frame[c].to_numpy() for c in ("mask", "mask2", "masked")]
        prints = frame["print"].to_numpy()
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(frame)]])
        # Buckets of one row inside the frame can't link; the first and last may go on.
        some = ends - starts > 1
        some[[0, -1]] = True
        for i, j in zip(starts[some].tolist(), ends[some].tolist()):
            this = tuple(int(c[i]) for c in columns)
            if this != key:
                close()
                held, key, size, over = [], this, 0, False
            held.append(prints[i:j])
            size += j - i
            if not second and size > bucket:
                over = True
                close()
                held = []
        yield from flush()
    if key is not None:
        close()
        yield from flush()


MASKS = covering_masks(list(range(64)))
INNER = {
    k: covering_masks([p for p in range(64) if not mask >> p & 1]) for k, mask in enumerate(MASKS)
}


@lru_cache(maxsize=None)
def free_bits(mask: int, mask2: int) -> tuple[int, ...]:
    """Positions in which two members of a bucket may differ."""
    held = MASKS[mask] | INNER[mask][mask2]
    return tuple(p for p in range(64) if not held >> p & 1)


def neighbour_forest(values: np.ndarray, free: tuple[int, ...], radius: int = RADIUS):
    """Edges that connect all close pairs of a bucket whose members differ only in ``free``.

    Small buckets compare directly. Otherwise the differences are enumerated: a change of at
    most ``radius`` free bits is looked up among the sorted values, which takes the same work
    for every value, however many its bucket holds. Of the pairs found only those that join
    two trees are kept.
    """
    from itertools import combinations

    values = np.unique(values)
    n = len(values)
    changes = [sum(1 << p for p in c) for r in range(1, radius + 1) for c in combinations(free, r)]
    if n <= max(BUCKET, len(changes)):
        return close_forest(values, radius)
    i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for change in changes:
        other = values ^ np.uint64(change)
        at = np.minimum(np.searchsorted(values, other), n - 1)
        found = np.flatnonzero((values[at] == other) & (values < other))
        i, j = np.concatenate([i, found]), np.concatenate([j, at[found]])
        if len(i) > 4 * n:
            kept = spanning_forest(i, j, n)
            i, j = i[kept], j[kept]
    kept = spanning_forest(i, j, n)
    return values[i[kept]], values[j[kept]]


def _masked(rows: DataFrame, masks: list[tuple[int, int, int]]) -> DataFrame:
    """One row a mask: ``(mask, mask2, masked, print)`` for (mask, mask2, bits) triples."""
    structs = F.array(*[
        F.struct(
            F.lit(m).cast("short").alias("mask"), F.lit(m2).cast("short").alias("mask2"),
            F.col("print").bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits)).alias("masked"),
        )
        for m, m2, bits in masks
    ])
    return rows.select("print", F.inline(structs))


FOUND = "kind byte, a long, b long, mask short"
ORDER = ("mask", "mask2", "masked", "print")


def close_edges(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints within the radius.

    Each fingerprint goes to one bucket a mask; close pairs share some bucket. Buckets stream
    through their task in sorted order. One that outgrows ``bucket`` is not compared there:
    its members are covered again by masks over their free bits, which spreads them over
    further buckets of bounded size. No pair within the radius is lost, no list of pairs is
    written.
    """
    first = _masked(prints, [(k, -1, bits) for k, bits in enumerate(MASKS)])
    found = staged(
        first.repartition("mask", "masked").sortWithinPartitions(*ORDER)
        .mapInPandas(lambda frames: _bucket_rows(frames, bucket, False), FOUND),
        "buckets",
    )
    edges = found.where("kind = 0").select("a", "b")
    crowded = found.where("kind = 1").select(F.col("a").alias("print"), "mask")
    # The inner masks of each mask, picked by the row's own mask.
    inner = F.array(*[
        F.array(*[F.lit((MASKS[k] | m) - (1 << 64) if (MASKS[k] | m) >> 63 else MASKS[k] | m) for m in INNER[k]])
        for k in range(len(MASKS))
    ])
    second = (
        crowded.select("print", "mask", F.posexplode(inner[F.col("mask").cast("int")]).alias("mask2", "bits"))
        .select("mask", F.col("mask2").cast("short").alias("mask2"),
                F.col("print").bitwiseAND(F.col("bits")).alias("masked"), "print")
        .repartition("mask", "mask2", "masked").sortWithinPartitions(*ORDER)
        .mapInPandas(lambda frames: _bucket_rows(frames, bucket, True), FOUND)
    )
    return edges.union(second.select("a", "b"))


def grouped(docs: DataFrame, text: str, bucket: int) -> DataFrame:
    """``(doc_id, body, print, component, component_id)`` for every row of ``docs``."""
    found = staged(fingerprints(docs, text), "prints")
    distinct = found.groupBy("print").agg(F.min("doc_id").alias("least"))
    components = connected_components(close_edges(distinct.select("print"), bucket))
    roots = distinct.join(
        components.select(F.col("node").alias("print"), "component"), "print", "left"
    ).select("print", "least", F.coalesce("component", "print").alias("component"))
    least = roots.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.join(roots.join(least, "component").select("print", "component", "component_id"), "print")


def near_duplicates(docs: DataFrame, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Documents link at ``RADIUS`` or fewer differing bits; ``component_id`` is the smallest
    doc_id reachable. Copies count as one fingerprint, so a group of a third of all rows is
    one entry in the search. Null and empty texts have fingerprint zero and link like others;
    repeated rows stay; rows without doc_id keep their component; an empty table gives no
    rows; other columns are ignored.
    """
    return grouped(docs, text, bucket).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    All columns stay as they were, whatever their names. Of rows repeating that doc_id in one
    group one stays; rows with one doc_id whose texts lie in different groups are different
    documents. Documents without doc_id form no groups and all stay; an empty table stays
    empty.
    """
    named = docs.where("doc_id is not null")
    # One row a group; the hash of its text tells it from other texts under the same doc_id.
    chosen = (
        grouped(named, text, bucket).groupBy("component").agg(F.min(F.struct("doc_id", "body")).alias("one"))
        .select("one.*").distinct()
    )
    # The row travels as one value, so that its columns can't clash with any of ours.
    rows = named.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), body_of(text).alias("body"))
    kept = rows.join(chosen.hint("merge"), ["doc_id", "body"], "left_semi")
    # Sorted by the join already, repeated rows follow each other: numbering them moves nothing.
    place = F.row_number().over(Window.partitionBy("doc_id", "body").orderBy("doc_id", "body"))
    kept = kept.withColumn("place", place).where("place = 1").select("row.*")
    return kept.union(docs.where("doc_id is null"))
