"""Sessions, and the package's own code for their workers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the engine's semantics assume."""
    builder = SparkSession.builder.master(master).appName("weft")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="weft-code-"))
    shutil.copytree(top, folder / "code" / top.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / top.name), "zip", folder / "code"))
    shutil.rmtree(folder / "code")
    _SHIPPED.add(context.applicationId)


_FOLDERS: dict[str, str] = {}


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share; what is there goes when the program ends.

    The folder is ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode
    and an error elsewhere.
    """
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
        atexit.register(_forget, context._jvm.org.apache.hadoop.fs.Path(_FOLDERS[key]), context._jsc.hadoopConfiguration())
    return f"{_FOLDERS[key]}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as Parquet: its plan starts anew from there."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(path, configuration) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        path.getFileSystem(configuration).delete(path, True)
