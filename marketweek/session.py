"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # For source files in encodings outside Spark's short list.
    "spark.sql.legacy.javaCharsets": "true",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings the library is tuned for."""
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError(
                "spark.checkpoint.dir is not set: point it to a folder all executors share"
            )
        shared = tempfile.mkdtemp(prefix="marketweek-checkpoint-")
    sc.setCheckpointDir(shared)
    return shared


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several later jobs read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Distribute few but expensive rows over all shuffle partitions.

    The explicit count keeps adaptive execution from merging the small partitions, which
    would put CPU-bound work on a handful of tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
