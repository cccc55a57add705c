"""Keyed state of stories: a stream in several orders, with late articles and a restart, gives the stories of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.streaming.stories import latest, stories_as_of, story_changes

SCHEMA = "id string, cluster_id string, publisher_id string, published_ts timestamp"


def articles():
    from datetime import datetime, timedelta

    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(f"a{k}", f"s{rng.randrange(14)}", rng.choice(["p", "q", "r", None]), start + timedelta(hours=rng.randrange(20 * 24))) for k in range(150)]
    rows += [("old", "s-old", "p", start), ("again", "s1", "p", start + timedelta(days=19)), ("again", "s1", "q", start + timedelta(days=18)), ("edge", "s-edge", "p", start + timedelta(days=13)), ("last", "s-last", "p", start + timedelta(days=20))]
    rows += [(f"quiet{k}", "s-quiet", "q", start + timedelta(days=14, hours=12 * k)) for k in range(4)]
    rows += [(None, "s1", "p", start + timedelta(days=19)), ("x", None, "p", start + timedelta(days=19)), ("y", "s1", "p", None)]
    return rows


def run(spark, folder, batches, restarts):
    """Each batch is a file; the query is stopped and started again after some of them."""
    source, out, check = f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"

    def keep(changes, n):
        changes.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")

    def drain():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = story_changes(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in restarts:
            drain()
    drain()
    return spark.read.parquet(out).drop("n")


@pytest.mark.parametrize("order", ["time", "mixed"])
def test_stream_gives_the_table(spark, tmp_path, order):
    rows = articles()
    whole = spark.createDataFrame(rows, SCHEMA)
    if order == "time":
        rows.sort(key=lambda r: (r[3] is None, r[3]))
    else:
        random.Random(1).shuffle(rows)
    batches = [rows[k::4] if order == "mixed" else rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4] for k in range(4)]
    changes = run(spark, str(tmp_path), batches, {1})
    want = {tuple(r) for r in stories_as_of(whole).collect()}
    assert {tuple(r) for r in latest(changes).collect()} == want and {r[5] for r in want} == {"active", "stale"}
    per_batch = changes.groupBy("batch").count().collect()
    if order == "time":
        assert changes.filter("status = 'gone'").count() > 0
        assert sum(r["count"] for r in per_batch) < len(per_batch) * 17  # not every story in every batch
