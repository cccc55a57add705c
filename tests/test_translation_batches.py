"""A worker of the translation hook holds few texts at once, however many rows it gets."""

import pyarrow as pa

from storyloom.operators import translation as T


def _plus(texts):
    return [None if t == "none" else t + "!" for t in texts]


def test_a_batch_is_returned_in_parts():
    texts = ["t" * 1000, None, " ", "none"] * 500
    rows = pa.RecordBatch.from_pydict({"id": list(range(2000)), "text": texts})
    parts = list(T._translate(iter([rows]), ["text"], _plus, {}))
    assert max(p.num_rows for p in parts) <= T.BATCH
    assert [x for p in parts for x in p["text"].to_pylist()] == [t + "!" if t and t.strip() and t != "none" else t for t in texts]
    assert [x for p in parts for x in p["id"].to_pylist()] == list(range(2000))


def test_rows_and_schema_stay(spark):
    rows = spark.createDataFrame([(1, "a", "en"), (2, None, "mt"), (3, "none", None)], "id int, text string, lang string")
    out = T.translated(rows, ["text"], _plus)
    assert out.schema == rows.schema and sorted(map(tuple, out.collect())) == [(1, "a!", "en"), (2, None, "mt"), (3, "none", None)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= T.MOST_BYTES
