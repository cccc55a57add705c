"""Links within buckets, with one key that most rows share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import buckets
from storyloom.llm.shared_store import Store


@pytest.mark.parametrize("members", [buckets.MEMBERS, 16])
def test_hot_key(spark, members, monkeypatch):
    """Every pair that is near and verified is linked, where the key fills several ranges, cells and rounds."""
    rng = np.random.default_rng(3)
    n = 400
    base = rng.integers(0, 2**63, (12, 4))
    rows = []
    for k in range(n):
        sketch = base[k % 12].copy()
        for _ in range(int(rng.integers(0, 14))):
            sketch[rng.integers(4)] ^= np.int64(1) << np.int64(rng.integers(63))
        rows.append((int(k), int(100 + k % 7), [int(x) for x in sketch]))
    table = spark.createDataFrame(rows, "id long, size long, sketch array<long>")
    near = lambda i, j: sum(int(x ^ y).bit_count() for x, y in zip(rows[i][2], rows[j][2])) <= 20
    linked = lambda a, b: (a * 31 + b * 17) % 5 < 2  # noqa: E731  what verification says of a pair, whatever its distance
    top = list(range(n))

    def of(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j) and linked(j, i):
                x, y = of(i), of(j)
                top[max(x, y)] = min(x, y)
    own = F.xxhash64("id")

    def rows_of(ids):
        return (table if ids is None else table.join(ids, "id", "left_semi")).select(F.explode(F.array(F.lit(7 << 40).cast("long"), own)).alias("key"), "id", "size", "sketch")

    limit = (lambda sizes: sizes - 50, lambda low, high: 20)
    verify = lambda pairs: pairs.filter((F.col("a") * 31 + F.col("b") * 17) % 5 < 2)
    got = {r.id: r.component for r in buckets.link_buckets([rows_of], limit, verify, Store(spark, "test"), members=members, nearest=1).collect()}
    assert {k: got.get(k, k) for k in range(n)} == {k: of(k) for k in range(n)}
