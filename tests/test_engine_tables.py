"""Versions, schemas, keys and counts of the engine's tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from storyloom.engine import SCHEMA_VERSION, Engine
from storyloom.sources.feeds import RAW


def raw(spark, rows):
    return spark.createDataFrame([(str(k), pub, f"https://a.b/c/{k}", head, "", "", "", "", "en", f"2024-01-01T1{n}:00:00+00:00", "", n) for n, (k, pub, head) in enumerate(rows)], RAW)


def test_counts_and_second_pass(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    heads = ["Enemalta tender awarded Floriana", "Enemalta tender awarded Floriana again", "Completely unrelated weather item"]
    failed = spark.createDataFrame([("net_news",)], "publisher_id string")
    rows = raw(spark, [(k, "newsbook", h) for k, h in enumerate(heads)])
    assert e.refresh(rows.unionByName(rows), "2024-01-04 00:00:00", failed=failed) == {"scraped": 6, "new": 3}
    assert e.stats == {"articles_scraped": 6, "articles_new": 3, "clusters_created": 2, "failed_sources": ["net_news"]}
    assert e.refresh(rows, "2024-01-04 00:00:00") == {"scraped": 3, "new": 0} and e.stats["clusters_created"] == 0


def test_stories_that_are_alike_are_merged(spark, tmp_path):
    """Two stored stories with one bag of words become one when a refresh brings something new."""
    e = Engine(spark, str(tmp_path))
    rows = raw(spark, [(k, p, "Enemalta Tender Awarded Floriana Project") for k, p in enumerate("pq")] + [(k, "newsbook", f"Quite other Matter{k} Number{k} Place{k}") for k in range(2, 30)])
    e.refresh(rows, "2024-01-04 00:00:00")
    e.split("1")
    before = e.get_clusters().count()
    e.refresh(raw(spark, [(40, "newsbook", "Nothing like the others Whatever")]), "2024-01-04 00:00:00")
    assert e.get_clusters().count() == before and {r.cluster_id for r in e.table("articles").filter("id in ('0', '1')").collect()} == {"0"}


def test_old_versions_and_intermediate_tables_go(spark, tmp_path):
    from storyloom.intermediate import shared_folder

    e = Engine(spark, str(tmp_path), keep_versions=2)
    shared = shared_folder(spark).removeprefix("file://")
    e.refresh(raw(spark, [(1, "newsbook", "A headline of one story")]), "2024-01-04 00:00:00")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    for _ in range(4):
        e.recluster()
    assert len([d for d in os.listdir(tmp_path / "articles") if d.startswith("v")]) == 2
    assert len([f for f in os.listdir(tmp_path / "_manifest") if f.endswith(".json") and not f.startswith(".")]) == 2
    assert e.get_clusters().count() == 1 and set(os.listdir(shared)) <= before


def test_first_schema_opens_with_the_last(spark, tmp_path):
    """A folder as the first commands wrote it: fewer columns, a manifest without a schema."""
    old = [("1", "newsbook", "https://a.b/1", "A headline of one story", "snippet", "", "en", "2024-01-01T10:00:00+00:00", "1")]
    spark.createDataFrame(old, "id string, publisher_id string, original_url string, headline string, snippet string, image_url string, language string, published_at string, cluster_id string").write.parquet(f"{tmp_path}/articles/v1")
    spark.createDataFrame([("1", "A headline", "2024-01-01T10:00:00+00:00", "2024-01-01T10:00:00+00:00", False)], "id string, headline string, first_reported string, last_updated string, is_blindspot boolean").write.parquet(f"{tmp_path}/clusters/v1")
    spark.createDataFrame([("own", "Own", "https://o.wn/feed", True)], "id string, name string, rss_url string, is_global boolean").write.parquet(f"{tmp_path}/custom_publishers/v1")
    os.mkdir(tmp_path / "_manifest")
    (tmp_path / "_manifest" / "1.json").write_text(json.dumps({"articles": 1, "clusters": 1, "custom_publishers": 1}))
    e = Engine(spark, str(tmp_path))
    assert e.schema_version() == 1
    row = e.table("articles").first()
    assert (row.translated_headline, row.body_text, row.category, row.snippet) == ("", "", "general", "snippet")
    assert e.table("custom_publishers").first().scrape_method == "rss" and e.cluster_summary().first().summary == "snippet"
    e.cache_bodies(spark.createDataFrame([("1", "body", "img")], "id string, body_text string, image_url string"))
    assert e.schema_version() == SCHEMA_VERSION and e.table("articles").first().category == "general" and e.table("articles").first().body_text == "body"
    assert e.table("custom_publishers").first().scrape_method == "rss" and e.get_clusters().count() == 1


def test_keys_are_checked(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.refresh(raw(spark, [(1, "newsbook", "A headline of one story"), (2, "newsbook", "Another thing entirely")]), "2024-01-04 00:00:00")
    with pytest.raises(ValueError):
        e._commit(articles=e.table("articles").withColumn("original_url", F.lit("same")))
    assert e.table("articles").select("original_url").distinct().count() == 2


def test_a_split_writes_one_row(spark, tmp_path):
    """Changes hold what differs, readers see it, enough of them become a base, and nothing old stays."""
    e = Engine(spark, str(tmp_path), keep_versions=1, compact_after=2)
    e.refresh(raw(spark, [(k, "newsbook", f"Quite other Matter{k} Number{k} Place{k}") for k in range(5)] + [(k, "p", "Enemalta Tender Awarded Floriana") for k in (7, 8)]), "2024-01-04 00:00:00")
    assert e.get_clusters().count() == 6
    e.split("8")
    change = spark.read.parquet(f"{tmp_path}/articles/d2")
    assert [(r.id, r.cluster_id) for r in change.collect()] == [("8", "split-8")] and os.path.isdir(tmp_path / "articles" / "v1")
    assert e.get_clusters().count() == 7 and e.table("articles").count() == 7
    e.split("8")  # nothing changes
    assert spark.read.parquet(f"{tmp_path}/articles/d3").count() == 0 and e.get_clusters().count() == 7
    e.merge(spark.createDataFrame([("split-8", "7"), ("3", "7")], "from_id string, to_id string"))
    folders = sorted(os.listdir(tmp_path / "articles"))
    assert [f for f in folders if f[0] == "d"] == [] and len([f for f in folders if f[0] == "v"]) == 1
    assert {r.id for r in e.table("articles").filter("cluster_id = '7'").collect()} == {"3", "7", "8"} and e.get_clusters().count() == 5
    e.cache_summaries(spark.createDataFrame([("7", "head", "sum")], "id string, ai_headline string, ai_summary string"))
    e.cache_bodies(spark.createDataFrame([("1", "body", "img"), ("none", "x", "y")], "id string, body_text string, image_url string"))
    assert {r.id: r.summary for r in e.cluster_summary().collect()}["7"] == "sum" and e.table("articles").filter("body_text = 'body'").count() == 1
