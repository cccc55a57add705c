"""The driver's contract, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from storyloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb
    import glob
    import os

    df = QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        return
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in sorted(names)]
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    expected = [tuple(r[k] for k in place) for r in cursor.fetchall()]
    assert sorted(repr(tuple(map(near, r))) for r in rows) == sorted(repr(tuple(map(near, r))) for r in expected)
