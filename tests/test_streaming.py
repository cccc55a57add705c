"""Stories kept by a stream."""

from storyloom.engine import Engine
from storyloom.sources.feeds import RAW
from storyloom.streaming.refresh import refresh, refresh_stories


def test_stories_over_batches(spark, tmp_path):
    e, src = Engine(spark, str(tmp_path / "tables")), str(tmp_path / "in")
    row = lambda k, day, head: (str(k), f"p{k}", f"https://a.b/{k}", head, "", "", "", "", "en", f"2024-01-{day:02d}T10:00:00+00:00", "", k)
    days = [
        [row(1, 1, "Enemalta tender awarded Floriana"), row(2, 2, "Weather warning issued Mosta")],
        [row(3, 3, "Enemalta tender awarded Floriana again"), row(1, 1, "Enemalta tender awarded Floriana")],  # one comes again
        [row(4, 9, "Weather warning issued Mosta again")],  # the first is eight days old; 72 hours have passed for the second
    ]
    seen = []
    for rows in days:
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(RAW).parquet(src)
        refresh(stream, refresh_stories(e), str(tmp_path / "cp"), once=True).awaitTermination()
        seen.append({r.id: r.cluster_id for r in e.table("articles").collect()})
    assert seen[0] == {"1": "1", "2": "2"}
    assert seen[1] == {"1": "1", "2": "2", "3": "1"}
    assert set(seen[2]) == {"2", "3", "4"} and seen[2]["3"] == "1" and seen[2]["4"] == "2"
    assert {r.id for r in e.table("clusters").collect()} == {"1", "2"}
