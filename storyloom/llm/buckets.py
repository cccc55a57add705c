"""Links within buckets of sketches: nearest pairs first, and then what is left between groups.

A bucket holds the rows of one key.  Two rows of it are near if their sizes and the Hamming distance of their sketches allow
a link.  Instead of all near pairs, a round takes for each row its nearest near rows of other groups, verifies those pairs and
contracts the linked ones to groups.  If a row has more near rows of other groups than that, the rows of its key that have a near
row go into the next round, which takes ``GROWTH`` times as many.  The rounds end when no row has more near rows of other groups
than it was paired with, so no near pair is left out, but copies of one text need few pairs each.  A round tests pairs of the round before
again where they did not link, at most one in ``GROWTH`` of its own; no lists of tested pairs go with the rows.

First round: rows are dealt out by key and a task holds ``MEMBERS`` rows of a key at once.  Keys that would fill half of a task or more, as a sample of the
ids tells, are cut into pieces that go to different tasks, and into the next round; so a key that a third of the rows share goes to many tasks.
Later rounds: large keys are cut into cells; rows outside a large key's largest group are sent to each of its cells, in blocks, the others to their own cell only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import parts
from .links import components, extended, partitions_for
from .shared_store import Store, keep_heap, release_memory
from .wordhash import U64, list_array, mix64

#: Rows of a key that one task compares with each other.
MEMBERS = 8192
#: Nearest rows that each row is paired with in the first round.
NEAREST = 2
#: Times as many in each further round.
GROWTH = 16
#: Cells of the table of nearest rows that a task holds at once.
TABLE = 1 << 21
#: Bytes of rows that a task gathers before it compares them.
HELD = 4 << 20
#: One id in so many tells how rows are dealt out.
SAMPLED = 64
#: Rows of a key that always go to one task.
FEW = 256
#: Bits of a row's sort key that hold its size; the others hold its bucket.
SIZE_BITS = 24
#: Columns of a packed table: id, size, sketch.
_TABLE = [np.int64, np.int64, U64]
_FAR = np.iinfo(np.int32).max
_SCHEMA = "a long, b long, cut long, cut_id long"

#: smallest(sizes) -> the least size of a partner that is not larger; most(sizes, sizes that are not smaller) -> largest distance.
Limit = tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]

#: sketches (a row of 64-bit words each) -> a row for each block: the upper 40 bits of a pass's keys, not negative.
Buckets = Callable[[np.ndarray], np.ndarray]


class Sketches:
    """Rows of 64-bit words; if widths differ they are powers of two, and a sketch folds to half its width by XOR of its halves."""

    def __init__(self, values: np.ndarray, widths: np.ndarray):
        self.widths, self.place, self.of = widths, np.zeros(len(widths), np.int64), {}
        at = np.cumsum(widths) - widths
        for w in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == w)
            self.place[rows] = np.arange(len(rows))
            self.of[w] = values.reshape(-1, w) if len(rows) == len(widths) else values[at[rows, None] + np.arange(w)]

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hamming distances of rows; the wider sketch is folded."""
        if len(self.of) == 1:
            (rows,), step = self.of.values(), 1 << 15
            return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(rows[i[k : k + step]] ^ rows[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step))])
        out = np.zeros(len(i), np.int64)
        kind = self.widths[i] << 32 | self.widths[j]
        for pair in np.unique(kind):
            w, x = int(pair >> 32), int(pair & 0xFFFFFFFF)
            pick, step = np.flatnonzero(kind == pair), max(1, (1 << 17) // max(w, x))
            for k in range(0, len(pick), step):
                p = pick[k : k + step]
                sides = [self.of[w][self.place[i[p]]], self.of[x][self.place[j[p]]]]
                for s in (0, 1):
                    while sides[s].shape[1] > min(w, x):
                        half = sides[s].shape[1] // 2
                        sides[s] = sides[s][:, :half] ^ sides[s][:, half:]
                out[p] = np.bitwise_count(sides[0] ^ sides[1]).sum(1, dtype=np.int64)
        return out


def nearest_pairs(bucket, ids, size, component, sketches: Sketches, limit: Limit, keep: int):
    """Rows sorted by (bucket, size): (rows, their nearest rows), and a mask of the rows that another round needs.

    A pair counts for its row of the smaller group, or else the later row.
    """
    smallest, most = limit
    n = len(bucket)
    best_d, best, found, touched = np.full((n, keep), _FAR, np.int32), np.full((n, keep), -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)
    if component is ids:
        weight = None
    else:
        _, group, rows_of = np.unique(mix64(mix64(bucket.view(U64)) + component.view(U64)), return_inverse=True, return_counts=True)
        weight = rows_of[group]
    least = smallest(size)
    active, step = np.arange(n - 1), 0
    while True:
        step += 1
        active = active[: np.searchsorted(active, n - step)]
        later = active + step
        # Sizes are sorted: what doesn't fit at this step won't at the next.
        active = active[(bucket[active] == bucket[later]) & (size[active] >= least[later])]
        if len(active) == 0:
            break
        i = active if component is ids else active[component[active] != component[active + step]]
        j = i + step
        d = sketches.distance(i, j)
        near = np.flatnonzero(d <= most(size[i], size[j]))
        i, j, d = i[near], j[near], d[near]
        same = ids[i] == ids[j]
        if same.any():
            i, j, d = i[~same], j[~same], d[~same]
        if len(i) == 0:
            continue
        touched[i] = touched[j] = True
        first = np.zeros(len(i), bool) if weight is None else weight[i] < weight[j]
        for own, other, dist in ((i[first], j[first], d[first]), (j[~first], i[~first], d[~first])):
            found[own] += 1
            worst = best_d[own].argmax(1)
            better = dist < best_d[own, worst]
            own, worst = own[better], worst[better]
            best_d[own, worst], best[own, worst] = dist[better], other[better]
    row, place = np.nonzero(best >= 0)
    over = np.unique(bucket[found > keep])
    return row, best[row, place], touched & np.isin(bucket, over) if len(over) else np.zeros(n, bool)


def _near_rows(batches: Iterator[pa.RecordBatch], limit: Limit, keep: int, members: int) -> Iterator[pa.RecordBatch]:
    """key (bucket and size), id, size, sketch (and component, whole, where they aren't id and the bucket) -> pairs
    (a, b) and (cut, cut_id): rows that another round needs, all rows of ``cut`` where cut_id is null.

    Rows come sorted by key.
    """
    held: list[pa.RecordBatch] = []
    none = np.zeros(0, np.int64)

    def out(a=none, b=none, cut=none, cut_id=None) -> pa.RecordBatch:
        no = lambda x: pa.nulls(len(x), pa.int64())
        named = no(cut) if cut_id is None else pa.array(cut_id)
        columns = [[pa.array(np.minimum(a, b)), no(cut)], [pa.array(np.maximum(a, b)), no(cut)], [no(a), pa.array(cut)], [no(a), named]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "cut", "cut_id"])

    def compared(table: pa.Table, bucket: np.ndarray) -> pa.RecordBatch:
        col = lambda c: pa.concat_arrays(table.column(c).chunks)
        of = lambda c: col(c).to_numpy(zero_copy_only=False)
        ids, size, sketch = of("id"), of("size"), col("sketch")
        whole = of("whole") if "whole" in table.column_names else bucket
        comp = of("component") if "component" in table.column_names else ids
        widths, values = np.diff(sketch.offsets.to_numpy()).astype(np.int64), sketch.flatten().to_numpy(zero_copy_only=False).view(U64)
        own, other, more = nearest_pairs(bucket, ids, size, comp, Sketches(values, widths), limit, keep)
        return out(ids[own], ids[other], whole[more], ids[more])

    def ready(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held)
        if len(sizes := table.column("size").to_numpy()) and sizes.max() >= 1 << SIZE_BITS:
            table = table.take(pa.array(np.lexsort((sizes, table.column("key").to_numpy() >> SIZE_BITS))))
        bucket = table.column("key").to_numpy() >> SIZE_BITS
        starts = np.flatnonzero(np.diff(bucket, prepend=~bucket[0]))
        ends = np.append(starts[1:], len(bucket))
        at = 0
        for s, e in zip(starts.tolist(), ends.tolist()):
            goes_on = e == len(bucket) and not final
            if goes_on and e - s < members:
                break
            if e - s > members or goes_on:  # a large bucket: chunks of it, and the rest in the next round
                if s > at:
                    yield compared(table.slice(at, s - at), bucket[at:s])
                for k in range(s, e, members):
                    yield compared(table.slice(k, min(members, e - k)), bucket[k : min(k + members, e)])
                yield out(cut=np.array([table.column("whole")[s].as_py() if "whole" in table.column_names else bucket[s]], np.int64))
                at = e
            elif (e - at) * keep >= TABLE // 8:
                yield compared(table.slice(at, e - at), bucket[at:e])
                at = e
        else:
            if at < len(bucket):
                yield compared(table.slice(at), bucket[at:])
            held = []
            return
        if s > at:
            yield compared(table.slice(at, s - at), bucket[at:s])
        held = table.slice(s).combine_chunks().to_batches()

    waiting = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        waiting += batch.nbytes
        if waiting >= HELD:  # many rows at once: the steps within are few calls each
            yield from ready(False)
            waiting = sum(b.nbytes for b in held) // 2
    if held:
        yield from ready(True)
    release_memory()


def _sampled(batches: Iterator[pa.RecordBatch], buckets: list[Buckets]) -> Iterator[pa.RecordBatch]:
    """Packed id, size, sketch -> k, key, count: of each pass the buckets of some ids."""
    for ids, _, sketch in parts.unpacked(batches, _TABLE):
        sketch = sketch.reshape(len(ids), -1)[mix64(ids.view(U64)) % U64(SAMPLED) == 0]
        for k, of in enumerate(buckets):
            key, count = np.unique(of(sketch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(count)], names=["k", "key", "count"])


def _deal(batches: Iterator[pa.RecordBatch], buckets: Buckets, n: int, pieces: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Packed id, size, sketch -> a row of each bucket, in the parts of the buckets; buckets of ``pieces`` in several parts."""
    keep_heap()
    cut = np.array(sorted(pieces), np.int64)
    into = np.array([pieces[x] for x in cut.tolist()], U64)
    for ids, size, sketch in parts.unpacked(batches, _TABLE):
        sketch = sketch.reshape(len(ids), -1)
        bucket = buckets(sketch)
        row = np.tile(np.arange(len(ids)), len(bucket))
        bucket = bucket.ravel()
        deal = mix64(bucket.view(U64))
        if len(cut):
            at = np.minimum(np.searchsorted(cut, bucket), len(cut) - 1)
            some = np.flatnonzero(cut[at] == bucket)
            deal[some] = mix64(deal[some] + mix64(ids[row[some]].view(U64)) % into[at[some]])
        yield parts.packed((deal % U64(n)).astype(np.int32), [bucket, ids[row], size[row], sketch[row]])
    release_memory()


def _near_parts(batches: Iterator[pa.RecordBatch], limit: Limit, keep: int, members: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_deal`` sorted by part -> as ``_near_rows``."""

    def ordered() -> Iterator[pa.RecordBatch]:
        for bucket, ids, size, sketch in parts.unpacked(batches, [np.int64, np.int64, np.int64, U64]):
            key = bucket << SIZE_BITS | np.minimum(size, (1 << SIZE_BITS) - 1)
            order = np.argsort(key)
            sketch = sketch.reshape(len(ids), -1)[order]
            yield pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(ids[order]), pa.array(size[order]), list_array(sketch.view(np.int64).ravel(), np.full(len(ids), sketch.shape[1]))], names=["key", "id", "size", "sketch"])

    keep_heap()
    yield from _near_rows(ordered(), limit, keep, members)


def _celled(rows: DataFrame, members: int) -> DataFrame:
    """key, id, size, sketch, component -> the same with ``whole`` (the key) and the cell's key in ``key``."""
    groups = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
    sizes = sizes.select(F.col("key").alias("whole"), F.col("top.component").alias("top"), F.ceil(F.col("n") / members).alias("cells"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("top.n")) / members)).alias("blocks"))
    both = rows.join(sizes, rows.key == sizes.whole)
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n)
    home = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda t: F.struct(place(1, F.col("cells")).alias("c"), t.alias("t")))
    abroad = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda c: F.struct(c.alias("c"), place(2, F.col("blocks")).alias("t")))
    everywhere = F.when(F.col("component") == F.col("top"), home).otherwise(F.array_distinct(F.concat(home, abroad)))
    cell = F.when(F.col("cells") == 1, F.array(F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("t")))).otherwise(everywhere)
    out = both.withColumn("cell", F.explode(cell))
    return out.select(F.when(F.col("cells") == 1, F.col("key")).otherwise(F.xxhash64("key", "cell.c", "cell.t")).alias("key"), "id", "size", "sketch", "component", "whole")


def link_buckets(passes: list[Callable[[DataFrame | None], DataFrame]], limit: Limit, verify: Callable[[DataFrame], DataFrame], store: Store, members: int | None = None, nearest: int = NEAREST, labels: DataFrame | None = None, table: tuple[DataFrame, list[Buckets], int] | None = None) -> DataFrame:
    """id, component of every id with a verified link to a near id of one of its keys, or in the groups ``labels``.

    passes: functions that give key (a 64-bit hash, of which the upper bits count), id, size, sketch (array<long>), one row for each key and
    id; of all ids, or of those in the table of ids that they are given.  Each pass has keys of its own and is shuffled alone, so the
    disk that shuffles take follows one pass.  limit: see ``Limit``.  verify: distinct pairs (a, b) -> those that link.
    table: id, size and sketch (all of one width) of all ids, packed (``parts``), functions that give the keys from sketches, and the rows that one of
    them gives at most; with it and without labels the first round has a pass for each of these and sends many rows at a time.
    """
    members = members or MEMBERS
    n = partitions_for(store.spark.range(0))
    # The bucket in the upper bits and the size in the lower make one number to deal and sort by.
    packed = F.shiftleft("key", SIZE_BITS).bitwiseOR(F.least("size", F.lit((1 << SIZE_BITS) - 1)).cast("long"))
    rows_of = [lambda ids, rows=rows: rows(ids).withColumn("key", F.shiftright("key", SIZE_BITS)) for rows in passes]

    def near(rows: DataFrame, keep: int, name: str, pieces: dict[int, int] | None = None) -> DataFrame:
        """pieces: into how many pieces rows of a key are dealt; None: by cells, which are small already."""
        bucket, at_once = F.col("key"), 1 << 40 if pieces is None else members
        deal = bucket if not pieces else F.when(bucket.isin(list(pieces)), F.xxhash64(bucket, F.pmod(F.xxhash64("id"), F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in pieces.items() for x in kv]), bucket)))).otherwise(bucket)
        # Without a number where rows are few and partitions can be joined.
        dealt = rows.repartition(deal) if pieces is None else rows.repartition(n, deal)
        dealt = dealt.withColumn("key", packed)
        out = store.write(dealt.sortWithinPartitions("key").mapInArrow(partial(_near_rows, limit=limit, keep=keep, members=at_once), _SCHEMA), name)
        store.settle()
        return out

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for other in frames[1:]:
            out = out.unionByName(other)
        return out

    columns = ["key", "id", "size", "sketch"]
    in_parts = table is not None and labels is None
    if in_parts:
        all_ids, buckets, most = table
        n_parts = parts.parts_for(all_ids, most)

    def large() -> list[dict[int, int]]:
        """Of each pass the keys that would fill half of a task or more, and their pieces: a few for each task at most."""
        if in_parts:
            some = all_ids.mapInArrow(partial(_sampled, buckets=buckets), "k int, key long, count long")
            counts = some.groupBy("k", "key").agg(F.sum("count").alias("count"))
        else:
            some = [rows(None).filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select(F.lit(k).alias("k"), "key") for k, rows in enumerate(rows_of)]
            counts = union(some).groupBy("k", "key").count()
        counts = store.write(counts, "sample")
        totals = counts.groupBy("k").agg(F.greatest(F.sum("count") / (2 * n), F.lit(FEW / SAMPLED)).alias("half"))
        out: list[dict[int, int]] = [{} for _ in (buckets if in_parts else passes)]
        for r in counts.join(F.broadcast(totals), "k").filter("count > half").select("k", "key", F.ceil(F.col("count") / F.col("half")).alias("pieces")).collect():
            out[r["k"]][r["key"]] = r["pieces"]
        store.free(counts)
        return out

    def first(k: int, pieces: dict[int, int]) -> list[DataFrame]:
        """The pairs of one pass; keys that are dealt out in pieces go into the next round, where they are cut into cells."""
        if in_parts:
            dealt = all_ids.mapInArrow(partial(_deal, buckets=buckets[k], n=n_parts, pieces=pieces), parts.schema(4))
            inside = store.write(dealt.repartition(n, "part").sortWithinPartitions("part").mapInArrow(partial(_near_parts, limit=limit, keep=nearest, members=members), _SCHEMA), f"near{k}")
            store.settle()
        else:
            df = rows_of[k](None)
            rows = df.select(*columns) if labels is None else grouped(df).select(*columns, "component")
            inside = near(rows, nearest, f"near{k}", pieces)
        return [inside, *([store.spark.createDataFrame([(None, None, key, None) for key in pieces], _SCHEMA)] if pieces else [])]

    found = [x for k, pieces in enumerate(large()) for x in first(k, pieces)]
    for round_no in range(40):
        pairs = store.write(union(found).filter("a is not null").select("a", "b").distinct(), f"pairs{round_no}")
        links = store.write(verify(pairs), f"verified{round_no}")
        linked = components(links, store) if labels is None else extended(labels, links, store)
        labels, before = store.write(linked, f"labels{round_no}"), labels
        # Of the rows that want another round, only those of keys whose rows are in different groups by now.
        cut = store.write(union(found).filter("cut is not null").select(F.col("cut").alias("key"), F.col("cut_id").alias("id")).distinct(), f"cut{round_no}")
        wanted = cut.join(labels, "id", "left").groupBy("key").agg(F.min(F.coalesce("component", "id")).alias("lo"), F.max(F.coalesce("component", "id")).alias("hi"), F.bool_or(F.col("id").isNull()).alias("whole"))
        wanted = store.write(wanted.filter("whole or lo <> hi").select("key", "whole"), f"wanted{round_no}")
        if wanted.isEmpty():
            return labels
        some = store.write(cut.join(wanted.filter("not whole"), "key", "left_semi"), f"some{round_no}")
        ids = store.write(some.select("id").distinct(), f"ids{round_no}")
        again = [rows(ids).join(some, ["key", "id"], "left_semi") for rows in rows_of]
        whole = wanted.filter("whole").select("key")
        if not whole.isEmpty():
            again += [rows(None).join(whole, "key", "left_semi") for rows in rows_of]
        rows = union(again)
        rows = store.write(grouped(rows).select(*columns, "component"), f"rows{round_no}")
        nearest = min(GROWTH * nearest, 4 * members)
        more = near(_celled(rows, members), nearest, f"more{round_no}")
        store.free(*found, rows, wanted, cut, *[x for x in (before, pairs, links) if x is not None])
        found = [more]
    raise RuntimeError("buckets did not settle")
