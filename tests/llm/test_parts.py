"""Rows that are shuffled many at a time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from storyloom.llm import buckets, line_dedup, parts
from storyloom.llm.shared_store import Store
from storyloom.llm.wordhash import U64


def test_parts_hold_their_rows():
    """Each part's rows come together, in order, from several batches and slices of them."""
    rng = np.random.default_rng(5)
    part, a, b = rng.integers(0, 70_000, 5000).astype(np.int32), np.arange(5000), rng.integers(0, 1 << 63, (5000, 3)).astype(U64)
    part[:4000] %= 7
    batches = [parts.packed(part[s : s + 1700], [a[s : s + 1700], b[s : s + 1700]]) for s in range(0, 5000, 1700)]
    table = pa.Table.from_batches(batches).sort_by("part").combine_chunks()
    halves = [*table.slice(0, 3).to_batches(), *table.slice(3).to_batches()]
    got = list(parts.unpacked(iter(halves), [np.int64, U64]))
    assert len(got) == len(set(part.tolist()))
    for ids, values in got:
        assert len(set(part[ids].tolist())) == 1 and np.array_equal(values.reshape(-1, 3), b[ids])
    assert sorted(np.concatenate([ids for ids, _ in got]).tolist()) == a.tolist()
    assert list(parts.unpacked(iter([]), [np.int64])) == []


def test_large_bucket_in_pieces(spark, monkeypatch):
    """A bucket that every row has goes to several tasks, and all its near rows are linked."""
    n, of_all = 2000, 7
    rows = [parts.packed(np.zeros(n, np.int32), [np.arange(n), np.full(n, 100), (np.arange(n) % 3).astype(U64)]).to_pylist()[0]]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], parts.schema(3))
    tasks = []
    written = Store.write

    def write(self, df, name):
        out = written(self, df, name)
        if name == "near0":
            tasks.append(out.filter("a is not null").select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(Store, "write", write)
    flat = spark.createDataFrame([(k, 100, [k % 3]) for k in range(n)], "id long, size long, sketch array<long>")
    rows_of = lambda ids: (flat if ids is None else flat.join(ids, "id", "left_semi")).select(F.lit(of_all << buckets.SIZE_BITS).cast("long").alias("key"), "id", "size", "sketch")
    same = lambda sketch: np.full((1, len(sketch)), of_all, np.int64)
    limit = (lambda sizes: sizes, lambda low, high: np.zeros(len(low), np.int64))
    got = {r.id: r.component for r in buckets.link_buckets([rows_of], limit, lambda pairs: pairs, Store(spark, "test"), table=(table, [same], n)).collect()}
    assert got == {k: k % 3 for k in range(n)} and (tasks[0] > 1 or parts.partitions_for(table) == 1)


def test_values_of_blocks():
    """A block's number and bits, as Spark's expressions of later rounds give them; also where they take more than 40 bits."""
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 1 << 63, (50, 8)).astype(U64) * U64(2) + U64(1)
    for bits in (16, 21, 40, 60):
        got = line_dedup.block_values(sketch, range(2, 5), bits, 64 // bits)
        for row, k in zip(got, range(2, 5)):
            for have, words in zip(row.tolist(), sketch.tolist()):
                value = (words[k // (64 // bits)] >> k % (64 // bits) * bits) % (1 << bits) + (k << bits) % (1 << 40)
                assert have % (1 << 40) == value % (1 << 40) and -(1 << 39) <= have < 1 << 39


def test_lines_are_not_rows(spark, monkeypatch):
    """Lines and their blocks are not shuffled one by one."""
    rows = {}
    written = Store.write

    def write(self, df, name):
        out = written(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Store, "write", write)
    docs = spark.createDataFrame([(d, "\n".join(f"line {k} of document {d} {d * k}" for k in range(200))) for d in range(40)], "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).agg(F.sum("__lines"), F.sum("__removed")).first()
    assert got[0] == 8000 and got[1] > 0 and rows["lines"] < 800
