"""The folder that the cluster shares, lineage cuts in it, and tables that are built once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_BUILT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; one of our own only in local mode, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="textquarry-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so a lost executor costs no upstream work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a stored table, by the file system that Spark reads it with."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = files.getContentSummary(place)
    return summary.getLength(), summary.getFileCount(), files.getFileStatus(place).getModificationTime()


def built_once(spark: SparkSession, name: str, path: str, build: Callable[[str], None]) -> str:
    """The folder that build(folder) filled from the table at `path`; built again when the table has changed."""
    key = (spark.sparkContext.applicationId, name, path, state_of(spark, path))
    if key not in _BUILT:
        out = fresh_dir(spark, name)
        build(out)
        _BUILT[key] = out
    return _BUILT[key]
