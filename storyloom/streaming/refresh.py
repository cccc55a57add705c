"""Structured Streaming around the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import INGEST_HOURS
from ..engine import Engine


def new_articles(stream: DataFrame, time_col: str = "published_ts", id_col: str = "id") -> DataFrame:
    """Each id once across micro-batches, as long as its copies come within the ingest window."""
    return stream.withWatermark(time_col, f"{INGEST_HOURS} hours").dropDuplicatesWithinWatermark([id_col])


def refresh(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes", once: bool = False) -> StreamingQuery:
    """Runs a batch refresh on every micro-batch; ``every`` is the cooldown."""
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def append_refresh(spark: SparkSession, articles_path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch step: adds articles that are not stored yet.  A batch that is run again after a failure adds nothing twice."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(["id"])
        target = f"{articles_path}/batch={batch_id}"
        seen = [r for r in _batches(spark, articles_path) if r != batch_id]
        if seen:
            stored = spark.read.parquet(*[f"{articles_path}/batch={b}" for b in seen]).select("id")
            rows = rows.join(stored, "id", "left_anti")
        rows.write.mode("overwrite").parquet(target)

    return step


def refresh_stories(engine: Engine, as_of: str | None = None) -> Callable[[DataFrame, int], None]:
    """A micro-batch step that keeps the engine's tables: articles older than the retention period go, new ones join stories or start them.

    ``as_of``: the time of the refresh; else the latest time of the batch.  The state is the engine's tables, so a batch that is run again
    after a failure finds its articles stored and adds nothing twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        latest = as_of or batch.agg(F.date_format(F.max(F.to_timestamp("published_at")), "yyyy-MM-dd HH:mm:ss")).first()[0]
        if latest:
            engine.refresh(batch, latest)

    return step


def _batches(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")) if fs.exists(p) else []


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
