"""Pairs of lines compared together, and large keys dealt out in pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import buckets, line_dedup
from storyloom.llm.shared_store import Store


def changed(rng, text):
    out = list(text)
    for _ in range(rng.randrange(len(text) // 4 + 3)):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.4:
            del out[at : at + 1]
        else:
            out[at : at + rng.randrange(2)] = rng.choice("abé😀")
    return "".join(out)


@pytest.mark.parametrize("longest, n", [(1, 50), (60, 3000), (700, 200)])
def test_near_texts(longest, n):
    """The same pairs as by one distance after another."""
    rng = random.Random(longest)
    a = ["".join(rng.choice("ab é😀"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(1, longest + 1))) for _ in range(n)]
    b = [changed(rng, x) for x in a]
    most = [int(0.2 * max(len(x), len(y)) + 1e-6) for x, y in zip(a, b)]
    want = [line_dedup.edits(x, y) <= k for x, y, k in zip(a, b, most)]
    assert line_dedup.near_texts(a, b, 0.8).tolist() == want and (longest == 1 or 0 < sum(want) < n)
    assert [line_dedup.edits(x, y, k) <= k for x, y, k in zip(a, b, most)] == want


def test_large_key_in_pieces(spark, monkeypatch):
    """A key that every row has is found by the sample, dealt to several tasks, and all its near rows are linked."""
    n = 2000
    table = spark.createDataFrame([(k, 100, [int(k % 3)]) for k in range(n)], "id long, size long, sketch array<long>")
    tasks = []
    written = Store.write

    def write(self, df, name):
        out = written(self, df, name)
        if name == "near0":
            tasks.append(out.filter("a is not null").select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(Store, "write", write)
    rows_of = lambda ids: (table if ids is None else table.join(ids, "id", "left_semi")).select(F.lit(7 << 40).cast("long").alias("key"), "id", "size", "sketch")
    limit = (lambda sizes: sizes, lambda low, high: np.zeros(len(low), np.int64))
    got = {r.id: r.component for r in buckets.link_buckets([rows_of], limit, lambda pairs: pairs, Store(spark, "test")).collect()}
    assert got == {k: k % 3 for k in range(n)} and (tasks[0] > 1 or buckets.partitions_for(table) == 1)
