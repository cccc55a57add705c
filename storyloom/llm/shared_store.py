"""Intermediate tables in the shared folder that the session names.

A written Parquet table cuts the lineage: if an executor is lost, later stages reread the
files rather than recompute Python work.  The folder is ``spark.checkpoint.dir``; where that is unset, a temporary
folder is made for a local session, and any other session is refused.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..intermediate import shared_folder


_settled = False


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows go to Python workers in batches of at most about ``size`` bytes, however long texts and sets are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, str(size))


def release_memory() -> None:
    """Gives memory that a finished task no longer needs back to the machine; Python workers live on for other tasks."""
    global _settled
    gc.collect()
    if not _settled:
        _settled = True
        gc.freeze()  # what lives now are modules, mostly; later tasks of this worker need not look through them again
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def keep_heap() -> None:
    """From now on arrays of up to 30 MB come from the heap that the worker holds, until ``release_memory``: glibc follows the largest block that was freed."""
    np.empty(30 << 20, np.uint8)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Store:
    """Tables written by one run of one operator; ``free`` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: set[str] = set()
        self._n = 0
        atexit.register(self._close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:02d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.add(path)
        out._store_path = path
        return out

    def free(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_store_path", None):
                _delete(self.spark, path)
                self._paths.discard(path)

    def keep_only(self, *frames: DataFrame) -> None:
        """Removes every table of this run but these, which the result still reads."""
        for path in self._paths - {f._store_path for f in frames}:
            _delete(self.spark, path)
            self._paths.discard(path)

    def settle(self) -> None:
        """Lets Spark remove the shuffle files of finished steps now, not when the driver's heap happens to be full."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session has ended; a cluster's folder has its own clean-up
            pass


def one_text_each(texts: DataFrame, store: Store) -> DataFrame:
    """doc_id, text: the same frame if no doc_id has different texts, else with the text of the smallest hash of each doc_id."""
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    bounds = texts.select("doc_id", hashed.alias("th")).groupBy("doc_id").agg(F.min("th").alias("least"), F.max("th").alias("most"))
    varied = store.write(bounds.filter("least <> most").select(F.col("doc_id").alias("varied"), "least"), "varied")
    if varied.isEmpty():
        return texts
    return texts.join(varied, F.col("doc_id") == F.col("varied"), "left").filter(F.col("least").isNull() | (hashed == F.col("least"))).select("doc_id", "text")
