"""Folders shared by all executors, and the tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
#: Spark's own setting: shuffle files go when the query that made them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error elsewhere."""
    context = spark.sparkContext
    key = context.applicationId
    if key not in _FOLDERS:
        base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="weft-checkpoints-")
            context.setCheckpointDir(base)
        _FOLDERS[key] = f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(_FOLDERS[key])
        atexit.register(_forget, path, context._jsc.hadoopConfiguration())
    return _FOLDERS[key]


def _forget(path, configuration) -> None:
    """Deletes the folder, also after the session was stopped: the JVM goes last."""
    with contextlib.suppress(Exception):  # the JVM may be gone all the same
        path.getFileSystem(configuration).delete(path, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage without depending on any one executor; shuffle files of the
    written plan are deleted with it.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``table`` that no later plan reads."""
    spark = df.sparkSession
    root = _root(spark)
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
