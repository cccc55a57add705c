"""The first counts of a table come from one shuffle of words, without a group of whole texts."""

from pyspark.sql import functions as F

from storyloom.operators import incremental as I


def test_texts_are_no_keys(spark, monkeypatch):
    plans = []
    written = I.written

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df)

    monkeypatch.setattr(I, "written", watched)
    rows = [("a1", "c1", "Alpha beta beta"), ("a2", "c1", "beta gamma"), ("a3", "c2", "beta"), ("a4", "c2", ""), ("a5", None, "delta"), ("a6", "c3", None), ("a3", "c2", "beta")]
    counts = I.counted(spark.createDataFrame(rows, "id string, cluster_id string, t string"), F.col("t"))
    assert not any("Join" in p or "Aggregate [id" in p for p in plans)
    assert {tuple(r) for r in counts.story_words.collect()} == {("c1", "alpha", 1), ("c1", "beta", 2), ("c1", "gamma", 1), ("c2", "beta", 2)}
    assert {tuple(r) for r in counts.words.collect()} == {("alpha", 1), ("beta", 2), ("gamma", 1)}
    assert {tuple(r) for r in counts.stories.collect()} == {("c1", 2), ("c2", 3), ("c3", 1)}
