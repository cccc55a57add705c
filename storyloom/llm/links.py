"""From block keys to connected groups, without all pairs of a bucket.

``key_runs`` deals (key, id) rows out by ranges of (key, id), so a key that a third of the rows
share is spread over many tasks, and reads each range in order.  Each run of one key gives
links to its first id only; runs cut by a range boundary are joined again through their
first rows.  ``components`` contracts verified links, ``extended`` adds links to groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared_store import Store


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions of the session, the size that the cluster's owner has chosen."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, id) -> key, hub, id, kind; kind 0: a member (the hub too), 1: an end of the range.

    The first and last run of a range may go on in another range, so even a run of one is kept there.
    """
    key = hub = None
    size, first_run, held = 0, True, None

    def rows(keys, hubs, ids, kinds):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hubs, pa.int64()), pa.array(ids, pa.int64()), pa.array(kinds, pa.int32())], names=["key", "hub", "id", "kind"])

    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        i = batch.column(1).to_numpy(zero_copy_only=False)
        if len(k) == 0:
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        if key is not None:
            new[0] = k[0] != key
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: goes on from the batch before
        hubs = np.where(run >= 0, i[starts[np.maximum(run, 0)]] if len(starts) else hub, hub if hub is not None else 0)
        lengths = np.bincount(run + 1, minlength=len(starts) + 1)
        whole = lengths[run + 1].copy()
        if lengths[0]:
            whole[run < 0] += size
        member = (whole > 1)
        out_k, out_h, out_i = [k[member]], [hubs[member]], [i[member]]
        if held is not None and lengths[0]:  # the run that a batch before ended with has more than one row
            out_k.insert(0, held[0]), out_h.insert(0, held[1]), out_i.insert(0, held[1])
            held = None
        if len(starts):
            if first_run and key is not None or key is None and len(starts) > 1:
                f_key, f_hub = (key, hub) if key is not None else (k[0], i[0])
                yield rows([f_key], [f_hub], [f_hub], [1])
                first_run = False
            key, hub = int(k[starts[-1]]), int(i[starts[-1]])
            size = int(lengths[-1])
            held = (np.array([key]), np.array([hub])) if size == 1 else None
        else:
            size += len(k)
        keys, hubs_, ids = np.concatenate(out_k), np.concatenate(out_h), np.concatenate(out_i)
        if len(keys):
            yield rows(keys, hubs_, ids, np.zeros(len(keys), np.int32))
    if key is not None:
        yield rows([key], [hub], [hub], [1])


def key_runs(keys: DataFrame, store: Store) -> DataFrame:
    """keys: key long, id long (distinct rows) -> key, hub, id for each row of a key that more than one row has.

    hub is the smallest id of the key within its range; where a key spans ranges, the hubs of the
    ranges are members of the first one's run as well, with kind 1.
    """
    n = partitions_for(keys)
    runs = store.write(keys.select("key", "id").repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_runs, "key long, hub long, id long, kind int"), "runs")
    ends = runs.filter("kind = 1")
    # Two rows a range: a few thousand rows whatever the input.
    first = ends.groupBy("key").agg(F.min("hub").alias("top"), F.countDistinct("hub").alias("n")).filter("n > 1").select("key", "top")
    across = ends.join(first, "key").select("key", F.col("top").alias("hub"), F.col("hub").alias("id"), F.lit(1).alias("kind"))
    return runs.filter("kind = 0").unionByName(across)


def components(edges: DataFrame, store: Store) -> DataFrame:
    """edges: a long, b long -> id, component: the smallest id that links reach, for every id that has a link.

    Each round maps an id to the least of its neighbourhood, follows that map twice, and relabels
    the links by it; links within one label go.  A star takes one round, a sorted path of n ids
    about log2(n).  Hot ids are only ever grouped with partial aggregation or joined by their label.
    """
    live = store.write(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = None
    for round_no in range(200):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        step = store.write(step, f"step{round_no}")
        onward = step.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jumped = step.join(onward, "up", "left").select("id", F.coalesce("top", "up").alias("up"))
        jumped = store.write(jumped, f"jump{round_no}")
        store.free(step)
        to_a, to_b = jumped.select(F.col("id").alias("a"), F.col("up").alias("ua")), jumped.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        nxt = live.join(to_a, "a").join(to_b, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        nxt = store.write(nxt, f"edges{round_no}")
        store.free(live)
        live = nxt
        if labels is None:
            labels = jumped.select("id", F.col("up").alias("component"))
        else:
            moved = labels.join(jumped.select(F.col("id").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
            old, labels = labels, store.write(moved, f"labels{round_no}")
            store.free(old)
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).filter("false")
    return labels


def extended(labels: DataFrame, edges: DataFrame, store: Store) -> DataFrame:
    """Groups of ``labels`` (id, component) and further links ``edges`` (a, b) together."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    raised = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = store.write(components(raised, store), "more")
    moved = labels.join(more.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    fresh = more.join(labels.select("id"), "id", "left_anti").select("id", "component")
    return store.write(moved.unionByName(fresh), "extended")
