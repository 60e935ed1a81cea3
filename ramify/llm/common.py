"""Shared helpers: scratch tables in the shared folder, worker imports, table access."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.plans.workers import is_local, ship  # noqa: F401

WHITESPACE = " \t\n\x0b\f\r"
#: Of an Arrow batch while a table is written. A batch of rows with two long texts each would take much more, in the JVM and again in Python.
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in whatever store it is; none if it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(target)] if store.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder is scratch space
        pass


class Scratch:
    """Tables written to the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session, whose executors are the driver itself, may do without; others
    fail, since each machine would write to a folder of its own. A table written here survives lost executors and cuts
    the lineage. Folders go when the driver ends, since a returned DataFrame may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not is_local(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="ramify-")
        self.path = f"{base.rstrip('/')}/ramify-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(delete, spark, self.path)

    def put(self, df: DataFrame, name: str = "t", rows_per_batch: int = 1000) -> DataFrame:
        """Write df, return a DataFrame that reads what was written. rows_per_batch: of the Arrow batches meanwhile, which have BATCH_BYTES at most, or one row more; that bounds a worker's memory."""
        self.count += 1
        path = f"{self.path}/{self.count:03d}-{name}"
        bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows_per_batch, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
        before = {k: self.spark.conf.get(k) for k in bounds}
        for k, v in bounds.items():
            self.spark.conf.set(k, v)
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ids_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the operators need; whatever else the table has is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def tidy(run: Callable[[Iterator], Iterator], *caches: dict) -> Callable[[Iterator], Iterator]:
    """run, after which the caches are emptied and free memory goes back: a worker lives on for other tasks, of whatever query."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            give_back()

    return wrapped


def give_back() -> None:
    """Return what the allocators hold without use to the system, where that can be done."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of at most max_bytes of text each, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end
