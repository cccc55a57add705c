"""Rows added one by one to a table with two unique keys, against a loop over them."""

import random
import sqlite3

import pytest

from storyloom.operators.conflicts import first_come, last_come

SCHEMA = "n int, id string, url string, what string"


def in_sqlite(rows, clause):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (id TEXT PRIMARY KEY, url TEXT UNIQUE, what TEXT)")
    for _, i, u, w in sorted(rows):
        db.execute(f"INSERT OR {clause} INTO t VALUES (?, ?, ?)", (i, u, w))
    return sorted(db.execute("SELECT id, url, what FROM t").fetchall())


def random_rows(seed):
    rng = random.Random(seed)
    n = rng.choice([5, 60, 400])
    keys = max(2, n // rng.choice([1, 2, 6]))
    return [(k, f"i{rng.randrange(keys)}", f"u{rng.randrange(keys)}", f"w{k}") for k in range(n)]


CASES = [random_rows(seed) for seed in range(5)] + [
    [(1, "A", "u1", "x"), (2, "B", "u1", "y"), (3, "B", "u2", "z"), (4, "C", "u3", "v")],
    [(k, f"i{k // 2}", f"u{(k + 1) // 2}", "chain") for k in range(24)],
    [(k, "hot", f"u{k}", "one id") for k in range(200)] + [(-k, f"i{k}", "u0", "one url") for k in range(1, 200)],
    [(1, "A", "u1", "x")] * 3 + [(1, "A", "u1", "y")],
    [],
]


@pytest.mark.parametrize("rows", CASES)
def test_against_sqlite(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.id, r.url, r.what) for r in first_come(df, ["id", "url"], "n").collect())
    assert got == in_sqlite(rows, "IGNORE")
    got = sorted((r.id, r.url, r.what) for r in last_come(df, ["id", "url"], "n").collect())
    assert got == in_sqlite(rows, "REPLACE")
