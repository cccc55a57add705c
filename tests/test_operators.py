"""Table changes, readers, roll-ups, the greedy rule and streams on small tables."""

import os

from pyspark.sql import functions as F

from storyloom.operators import changes as C, greedy as G, similarity as Y, stories as R
from storyloom.sources import feeds as S
from storyloom.streaming.refresh import append_refresh, counts_by_window, new_articles, refresh

ART = "id string, original_url string, publisher_id string, headline string, published_at string, cluster_id string"


def test_insert_skips_both_keys(spark):
    old = spark.createDataFrame([("1", "u1", "p", "h", "t", None)], ART)
    new = spark.createDataFrame([("1", "u9", "p", "h", "t", None), ("2", "u1", "p", "h", "t", None), ("3", "u3", "p", "h", "t", None), ("3", "u4", "p", "h", "s", None), ("4", "u5", None, "h", "t", None)], ART)
    assert sorted(r.original_url for r in C.insert_articles(old, new, "published_at").collect()) == ["u1", "u4"]


def test_merge_and_split(spark):
    art = spark.createDataFrame([("1", "u1", "p", "h", "t1", "a"), ("2", "u2", "p", "h", "t2", "b"), ("3", "u3", "p", "h", "t3", "b")], ART)
    cl = spark.createDataFrame([("a", "h", "t", "t", False, "", ""), ("b", "h", "t", "t", False, "", "")], "id string, headline string, first_reported string, last_updated string, is_blindspot boolean, ai_headline string, ai_summary string")
    moved, left = C.merge_clusters(art, cl, spark.createDataFrame([("a", "b")], "from_id string, to_id string"))
    assert {r.cluster_id for r in moved.collect()} == {"b"} and [r.id for r in left.collect()] == ["b"]
    moved, left = C.split_article(art, cl, "1", "n")
    assert sorted(r.id for r in left.collect()) == ["b", "n"]
    kept, stories = C.prune(art, cl, "t2")
    assert sorted(r.id for r in kept.collect()) == ["2", "3"] and [r.id for r in stories.collect()] == ["b"]


def test_coverage_sums_to_hundred(spark):
    rows = [("x", b) for b in ["state_owned", "party_owned_pl", "party_owned_pn"]] + [("y", b) for b in ["party_owned_pl"] * 2 + ["party_owned_pn"] + ["commercial_independent"] * 4]
    got = {r.cluster_id: r for r in R.bias_coverage(spark.createDataFrame(rows, "cluster_id string, bias string"), F.col("bias")).collect()}
    assert (got["x"].state_owned, got["x"].party_owned_pl, got["x"].party_owned_pn) == (34, 33, 33)
    assert (got["y"].party_owned_pl, got["y"].party_owned_pn, got["y"].commercial_independent) == (29, 14, 57)


def test_feeds(spark):
    rss = """<rss><item><title>Hello &amp; all</title><link>https://a.b/1</link><description>&lt;p&gt;Text&lt;/p&gt; The post X</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><enclosure url="https://i/1.jpg" type="image/jpeg"/></item>
    <item><title>Old one</title><link>https://a.b/2</link><pubDate>Mon, 01 Jan 2020 10:00:00 +0000</pubDate></item><item><title>No date</title><link>https://a.b/3</link></item></rss>"""
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    got = sorted(S.feed_articles(spark.createDataFrame([("p", "en", rss)], "publisher_id string, language string, body string"), as_of).collect(), key=lambda r: r.pos)
    assert [(r.headline, r.original_url, r.snippet, r.image_url) for r in got] == [("Hello & all", "https://a.b/1", "Text", "https://i/1.jpg"), ("No date", "https://a.b/3", "", "")]
    site = "<urlset><url><loc>https://a.b/x</loc><news:title>A title long enough</news:title><news:publication_date>2024-01-01</news:publication_date></url><url><loc>https://a.b/y</loc><news:title>Another long title</news:title></url></urlset>"
    files = spark.createDataFrame([("p", "en", site)], "publisher_id string, language string, body string")
    assert [r.original_url for r in S.sitemap_articles(files, as_of).collect()] == ["https://a.b/x"]
    assert S.sitemap_articles(files, as_of, date_only=False).count() == 0
    page = '<div class="n"><h3>A headline that is long</h3><a href="/s/1.html">x</a></div><div class="n"><a href="/s/1.html">again again again</a></div>'
    front = spark.createDataFrame([("p", "en", page, "div.n a[href]", "", "", "href", "https://a.b")], "publisher_id string, language string, body string, article_sel string, headline_sel string, image_sel string, link_attr string, base_url string")
    assert S.page_links(front, as_of).count() == 0  # the first text is too short, and the second link is the same


def test_greedy_and_merges(spark):
    rows = [("1", "p", "2024-01-01T00:00:00Z", "general", "Enemalta tender awarded Floriana"), ("2", "q", "2024-01-01T01:00:00Z", "general", "Enemalta tender awarded Floriana again"), ("3", "q", "2024-01-01T02:00:00Z", "general", "Weather stays warm")]
    art = spark.createDataFrame(rows, "id string, publisher_id string, published_at string, category string, headline string")
    got = {r.id: r.cluster_id for r in G.greedy_assign(art, F.col("headline")).collect()}
    assert got == {"1": "1", "2": "1", "3": "3"}


def test_stream_adds_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    one = spark.createDataFrame([("1", "2024-01-01 00:00:00"), ("2", "2024-01-01 00:00:00"), ("1", "2024-01-01 00:00:00")], "id string, t string").withColumn("published_ts", F.to_timestamp("t")).drop("t")
    one.write.parquet(src)
    for k in range(2):
        stream = spark.readStream.schema(one.schema).parquet(src)
        refresh(new_articles(stream), append_refresh(spark, out), str(tmp_path / "cp"), once=True).awaitTermination()
        one.filter("id = '2'").write.mode("append").parquet(src)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2"]
    assert os.path.isdir(out)


def test_windows(spark):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, event_type string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in counts_by_window(events).collect()) == [1, 2]
