"""Cutting the lineage of iterative plans by tables in the shared folder, and the size check before a broadcast."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast: of an id and a few numbers, some 20 MB.
BROADCAST_ROWS = 200_000
_PATH = "_ramify_path"


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="ramify-")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder is scratch space
        pass


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{_folder(spark)}/ramify-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a table in spark.checkpoint.dir (a temporary folder only in local mode, where none is set).

    Its size is known from then on. instead_of: what an earlier cut returned and nobody reads any more; its files go. All go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    if instead_of is not None:
        drop(instead_of)
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of what cut returned."""
    if path := getattr(df, _PATH, None):
        _delete(df.sparkSession, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table that cut has made, to be broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.count() <= rows else df
