"""Tables written once because several steps read them, in the shared folder that the session names."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and all runs in one process, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or ""
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="storyloom-")
    return _LOCAL[app]


#: The paths of the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within go at its end: for work whose result is written elsewhere before it ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def written(df: DataFrame, outer: bool = False) -> DataFrame:
    """The rows as a Parquet table that goes with the scope around it, else when the driver ends; lost executors lose none of it.

    outer: with the scope around that one, as the result of a round whose other tables go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    scopes = _SCOPES[:-1] if outer else _SCOPES[:]
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    # Nothing reads the step's shuffles any more; they go now, not when the driver's heap happens to be full.
    gc.collect()
    spark._jvm.System.gc()

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; a cluster's folder has its own clean-up
            pass

    if not scopes:
        atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``name``: 1, 2, 3 ... in the order given, which must be total: ranges are sorted by themselves, and a range starts after the rows of those before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, own).join(F.broadcast(before), "__range").withColumn(name, (F.col(name) + F.col("before")).cast("int")).select(*df.columns, name)
