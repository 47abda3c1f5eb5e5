"""Shards by way of fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketweek.llm.storage import staged

SLOTS = 4096


def sized(docs: DataFrame, text: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, virtual_slot)`` of every row.

    The slot is the id's hash; rows without an id are dealt by their text.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(content) + F.lit(1)).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.pmod(F.when(doc_id.isNotNull(), F.xxhash64(doc_id)).otherwise(F.xxhash64(content)), F.lit(slots))
        .cast("int").alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows of every used slot: at most one row a slot."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(totals: dict[int, int], shards: int) -> dict[int, int]:
    """Slots in falling size, each into the shard with the fewest bytes so far."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for slot, size in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        filled, shard = heap[0]
        placed[slot] = shard
        heapq.heapreplace(heap, (filled + size, shard))
    return placed


def rebalanced(current: dict[int, int], totals: dict[int, int], shards: int) -> dict[int, int]:
    """Edit a map for other totals or another number of shards, moving as few bytes as it can.

    Slots of removed shards are dealt anew. Then the fullest shard keeps giving the emptiest
    one its largest slot that fits in half of their difference, until none fits.
    """
    edited = {slot: shard for slot, shard in current.items() if shard < shards}
    filled = [0] * shards
    inside: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in edited.items():
        filled[shard] += totals.get(slot, 0)
        inside[shard].append((totals.get(slot, 0), slot))
    for size, slot in sorted(((totals[s], s) for s in totals if s not in edited), key=lambda x: (-x[0], x[1])):
        shard = min(range(shards), key=lambda k: (filled[k], k))
        edited[slot] = shard
        filled[shard] += size
        inside[shard].append((size, slot))
    while True:
        low = min(range(shards), key=lambda k: (filled[k], k))
        high = max(range(shards), key=lambda k: (filled[k], -k))
        room = (filled[high] - filled[low]) / 2
        fits = [x for x in inside[high] if 0 < x[0] <= room]
        if not fits:
            return edited
        size, slot = max(fits)
        inside[high].remove((size, slot))
        inside[low].append((size, slot))
        filled[high] -= size
        filled[low] += size
        edited[slot] = low


def map_table(spark: SparkSession, placed: dict[int, int], version: int) -> DataFrame:
    return spark.createDataFrame(
        [(version, slot, shard) for slot, shard in sorted(placed.items())],
        "version int, virtual_slot int, shard int",
    )


def store_map(spark: SparkSession, path: str, placed: dict[int, int], version: int) -> None:
    """Append one version of the map; earlier versions stay readable."""
    map_table(spark, placed, version).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """One version of a stored map, the newest by default; it has at most one row a slot."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return {r.virtual_slot: r.shard for r in table.where(F.col("version") == version).collect()}


def shard(docs: DataFrame, shards: int = 8, text: str = "text", slots: int = SLOTS,
          current: dict[int, int] | None = None, version: int = 0) -> DataFrame:
    """Put every row into a shard so that shards hold nearly equal bytes (law ``bytes``).

    Rows hash to ``slots`` fixed virtual slots; bytes are added up per slot before any
    shuffle. The slot totals, at most ``slots`` rows, are all the driver sees: it fills the
    map (or edits ``current``) from them. ``slot`` is the row's place in its shard, gapless
    from 0: the map table carries the rows before each virtual slot, and places inside a
    virtual slot follow (doc_id, text_crc32, size), so no task numbers a whole shard. The
    text itself is never shuffled.

    A null text counts one byte and has the checksum of no bytes. Repeated rows stay, with a
    place each; rows without doc_id are dealt by text; an empty table gives no rows; other
    columns of ``docs`` are ignored. Sizes differ by at most about the largest slot's share.
    """
    rows = staged(sized(docs, text, slots), "sized")
    counted = {r.virtual_slot: (r.bytes, r.rows) for r in slot_totals(rows).collect()}
    totals = {slot: n for slot, (n, _) in counted.items()}
    placed = first_map(totals, shards) if current is None else rebalanced(current, totals, shards)
    before, mapped = [0] * shards, []
    for slot in sorted(counted):
        mapped.append((slot, placed[slot], before[placed[slot]], version))
        before[placed[slot]] += counted[slot][1]
    table = rows.sparkSession.createDataFrame(
        mapped, "virtual_slot int, shard int, before long, map_version int"
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # The map has at most `slots` rows.
    return (
        rows.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(table), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("inside")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
        )
    )
