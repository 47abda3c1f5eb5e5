"""Written stages in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folders: dict[str, str] = {}
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own in a single-process session.

    A cluster session without the setting is an error: a folder of one machine would be
    invisible to the other executors.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{SETTING} is not set: name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="llm-stages-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return f"file://{_own_folders[app]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends there and lost executors cost nothing.

    Nothing goes back before the written table, so the shuffle files behind it are removed as
    soon as it is written, instead of some time later with the driver's garbage. The written table has the same columns; an empty table stays empty with its schema.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it on their path.

    A small archive of the package's source goes through Spark's own file distribution, once
    a session; nothing is sent where PYTHONPATH already leads to the package.
    """
    package = Path(__file__).resolve().parents[1]
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="llm-source-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
