"""Queries of the dealt operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweek.llm import (
    attribution, divergence, licences, negatives, packing, pivots, repair, sampling, simhash, slots, topk, windows, wrappers,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(_table(spark, sf_dir, "documents"))


def op5_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.segmentations(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "perturbed", "inclusion", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
    )


def op6_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op9_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard(_table(spark, sf_dir, "documents"))


def op8_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(_table(spark, sf_dir, "documents"))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.passage_classes(_table(spark, sf_dir, "documents"))


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved))


def op12_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(_table(spark, sf_dir, "conversations"))


def op13_pivot_annuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_hilbert_packing, op2_covering_simhash, op3_pivot_index, op4_offset_attribution,
        op5_gumbel_segmentations, op6_wrapper_induction, op7_virtual_slots, op8_divergence_rules,
        op9_licence_classifier, op10_compact_windows, op11_kronecker_negatives, op12_branch_and_bound, op13_pivot_annuli,
    )
}

#: Integer vectors of the rows that take part.
_INTEGERS = """
rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""
_NEGATIVES_SQL = f"""
WITH {_INTEGERS.format(scale=256)},
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND b.label IS NOT NULL
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
_TOP_SQL = f"""
WITH {_INTEGERS.format(scale=64)}
SELECT q.vec_id AS query_id,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank,
  c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""
ORACLES: dict[str, str] = {"op11_kronecker_negatives": _NEGATIVES_SQL, "op13_pivot_annuli": _TOP_SQL}
