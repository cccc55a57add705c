"""A day of the application on a few articles."""

import pytest
from pyspark.sql import functions as F

from storyloom.engine import Engine, read_words
from storyloom.operators import changes as C
from storyloom.operators.translation import in_batches
from storyloom.sources.feeds import RAW


def test_commands(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    row = lambda k, pub, head, lang="en": (str(k), pub, f"https://a.b/c/{k}", head, "", "snip" if k == 1 else "", "", "", lang, f"2024-01-0{k}T10:00:00+00:00", "", k)
    raw = [row(1, "one_news", "Enemalta tender awarded Floriana"), row(2, "one_news", "Enemalta tender awarded Floriana again"), row(3, "newsbook", "Completely unrelated weather item", "mt")]
    raw = [r if r[0] != "2" else (*r[:9], "2024-01-01T11:00:00+00:00", *r[10:]) for r in raw]
    assert e.refresh(spark.createDataFrame(raw, RAW), "2024-01-04 00:00:00") == {"scraped": 3, "new": 3}
    assert e.refresh(spark.createDataFrame(raw, RAW), "2024-01-04 00:00:00") == {"scraped": 3, "new": 0}
    feed = {r.id: r for r in e.get_clusters().collect()}
    assert sorted(len(r.articles) for r in feed.values()) == [1, 2] and feed["1"].is_blindspot
    assert {r.id: r.summary for r in e.cluster_summary().collect()}["1"] == "snip"
    assert e.split("2") == "split-2" and e.get_clusters().count() == 3
    e.merge(spark.createDataFrame([("split-2", "1")], "from_id string, to_id string"))
    assert e.get_clusters().count() == 2
    e.recluster()
    assert e.get_clusters().count() == 2
    e.cache_bodies(spark.createDataFrame([("1", "body", "img")], "id string, body_text string, image_url string"))
    assert e.table("articles").filter("id = '1'").first().body_text == "body"
    e.add_publisher(spark.createDataFrame([("own", "Own", "https://o.wn/feed", "rss", "", True)], "id string, name string, rss_url string, scrape_method string, scrape_config string, is_global boolean"))
    assert e.get_publishers().count() == 10
    e.remove_publisher("own")
    e.wipe()
    assert e.table("articles").count() == 0 and e.get_publishers().count() == 9


def test_failed_command_changes_nothing(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path))
    raw = [("1", "newsbook", "https://a.b/c/1", "A headline of one story", "", "", "", "", "en", "2024-01-01T10:00:00+00:00", "", 1)]
    e.refresh(spark.createDataFrame(raw, RAW), "2024-01-04 00:00:00")
    broken = e.table("articles").withColumn("cluster_id", F.raise_error(F.lit("down")).cast("string"))
    monkeypatch.setattr(C, "split_article", lambda *a: (broken, e.table("clusters").limit(0)))
    with pytest.raises(Exception):
        e.split("1")
    assert e.get_clusters().count() == 1


def test_sources_bodies_and_translation(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    sites = spark.createDataFrame([("own", "a.b", "", True), ("none", "c.d", "x", False)], "site string, url string, name string, is_global boolean")
    page = "<html><head><title>The Site</title><link rel='alternate' type='application/rss+xml' href='/f.xml'></head></html>"
    fetched = spark.createDataFrame([("https://a.b", page), ("https://a.b/f.xml", "<rss></rss>"), ("https://a.b/1", "<article><p>A paragraph of the first article here.</p><p>Another paragraph of that article.</p></article>")], "url string, body string")
    e.discover_publishers(sites, fetched)
    assert [(r.id, r.name, r.rss_url, r.scrape_method) for r in e.table("custom_publishers").collect()] == [("own", "The Site", "https://a.b/f.xml", "rss")]
    raw = [("1", "newsbook", "https://a.b/1", "A headline of one story", "", "snippet", "", "", "en", "2024-01-01T10:00:00+00:00", "", 1)]
    e.refresh(spark.createDataFrame(raw, RAW), "2024-01-04 00:00:00")
    wanted = spark.createDataFrame([("1",)], "id string")
    assert e.article_bodies(wanted, fetched).first().body_text.startswith("A paragraph")
    assert e.article_bodies(wanted, fetched.limit(0)).first().body_text.endswith("that article.")  # from the table
    told = e.translate_summary("1", lambda texts: [t.upper() for t in texts]).first()
    assert (told.headline, told.summary) == ("A HEADLINE OF ONE STORY", "SNIPPET")


def test_in_parts(spark, tmp_path):
    """Two refreshes and a new assignment of all: the stories are the same whether a period is one group or goes in parts."""
    names = ("Enemalta tender awarded", "Floriana garden opened", "Harbour bridge closed")
    raw = [(f"a{k:02d}", f"p{k % 4}", f"https://a.b/{k}", f"{names[k % 3]} {'again ' * (k % 2)}Topic{k % 5} day{k}", "", "", "", "", "en", f"2024-01-0{1 + k % 3}T{k % 24:02d}:00:00+00:00", "", k) for k in range(30)]
    seen = []
    for rows in (1000, 0):
        e = Engine(spark, str(tmp_path / str(rows)), desk_rows=rows)
        stories = lambda: sorted((r.id, r.cluster_id) for r in e.table("articles").collect())  # noqa: E731, B023
        e.refresh(spark.createDataFrame(raw[:20], RAW), "2024-01-04 00:00:00")
        e.refresh(spark.createDataFrame(raw[20:], RAW), "2024-01-04 00:00:00")
        kept = stories()
        e.recluster()
        seen.append((kept, stories(), e.stats))
    assert seen[0] == seen[1] and 1 < len({c for _, c in seen[0][0]}) < 30


def test_translator_that_fails():
    calls = []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3 or "bad" in texts:
            raise OSError("down")
        return [t + "!" if t != "none" else None for t in texts]

    assert in_batches(["a", None, " ", "none", "b"], flaky, batch=2, wait=0) == ["a!", None, " ", "none", "b!"]
    assert in_batches(["bad", "x"], flaky, batch=1, wait=0) == ["bad", "x!"]


def test_own_stop_words(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("Enemalta\n\n tender \n")
    words = read_words(spark, str(tmp_path / "stop.txt"))
    assert words == ["enemalta", "tender"]
    raw = [(str(k), f"p{k}", f"https://a.b/{k}", "Enemalta tender " + rest, "", "", "", "", "en", "2024-01-01T10:00:00+00:00", "", k) for k, rest in enumerate(("awarded", "delayed"))]
    count = lambda **kw: (e := Engine(spark, str(tmp_path / str(len(kw))), **kw)).refresh(spark.createDataFrame(raw, RAW), "2024-01-04 00:00:00") and e.get_clusters().count()
    assert count() == 1 and count(stop_words=words) == 2
