"""The fetching source: files and a small server stand for sites."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from storyloom.sources import fetch as N
from storyloom.sources.discover import dispatch, failed_sources

FEED = '<?xml version="1.0"?><rss><channel><item><title>Story number {k}</title><link>https://ex.com/{k}</link></item></channel></rss>'


class Site(BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):
        Site.asked.append(self.path)
        if self.path == "/slow":
            time.sleep(3)
        if self.path == "/gone":
            self.send_error(404)
            return
        self.send_response(200)
        self.send_header("Content-Type", "text/plain; charset=iso-8859-1")
        self.end_headers()
        if self.path == "/drip":
            for _ in range(40):
                self.wfile.write(b"x" * 10)
                self.wfile.flush()
                time.sleep(0.1)
        else:
            self.wfile.write("café".encode("iso-8859-1") if self.path == "/text" else b"x" * 5000)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_answers_and_failures(spark, site):
    N.register(spark)
    urls = [f"{site}/{p}" for p in ("text", "gone", "slow", "drip", "big")] + ["http://127.0.0.1:9/none", "ftp://x.y/z", "file:///no/such/file"]
    began = time.time()
    rows = spark.read.format("fetch").options(urls="\n".join(urls + [urls[0], ""]), timeout="1", max_bytes="2000", attempts="2", per_partition="2").load()
    assert rows.rdd.getNumPartitions() == 4
    got = {r.url.rsplit("/", 1)[1] if r.url.startswith(site) else r.url.split(":")[0]: r for r in rows.collect()}
    assert len(got) == 8 and time.time() - began < 30
    assert (got["text"].status, got["text"].body, got["text"].error, got["text"].attempts) == (200, "café", None, 1)
    assert (got["gone"].status, got["gone"].body, got["gone"].error) == (404, None, "status 404")
    assert all(got[k].body is None and got[k].error and got[k].attempts == 2 for k in ("slow", "drip", "big", "http", "ftp", "file"))
    assert "bytes" in got["big"].error and "timed out" in got["drip"].error


def test_fetched_table_feeds_the_readers(spark, tmp_path):
    """Sources as files: those that can be read become articles, the others are reported."""
    for k in range(3):
        (tmp_path / f"{k}.xml").write_text(FEED.format(k=k))
    (tmp_path / "bad.xml").write_text("no feed")
    sources = spark.createDataFrame([(f"p{n}", "en", "rss", f"file://{tmp_path}/{n}.xml") for n in ("0", "1", "2", "bad", "missing")], "publisher_id string, language string, method string, url string")
    empty = {c: F.lit("") for c in ("article_sel", "headline_sel", "image_sel", "link_attr", "base_url")}
    via_table = N.fetched(sources)
    via_format = N.register(spark).read.format("fetch").option("urls", N.addresses(sources)).load()
    for brought in (via_table, via_format):
        files = sources.join(brought.select("url", "body"), "url", "left").withColumns(empty)
        articles = dispatch(files, F.lit("2024-01-10 00:00:00").cast("timestamp"))
        assert sorted(r.headline for r in articles.collect()) == [f"Story number {k}" for k in range(3)]
        assert sorted(r.publisher_id for r in failed_sources(files).collect()) == ["pbad", "pmissing"]


def test_rounds_of_a_stream(spark, tmp_path):
    """One fetch of each source in a round; a restart within the round fetches nothing again."""
    (tmp_path / "a.xml").write_text("one")
    (tmp_path / "b.xml").write_text("two")
    urls = "\n".join(f"file://{tmp_path}/{n}.xml" for n in ("a", "b"))

    def drain():
        stream = N.register(spark).readStream.format("fetch").options(urls=urls, every="100000", per_partition="1").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.body for r in spark.read.schema(N.FETCHED).parquet(f"{tmp_path}/out").collect())

    assert drain() == ["one", "two"]
    assert drain() == ["one", "two"]


def test_no_sources(spark):
    assert N.register(spark).read.format("fetch").load().count() == 0
    assert N.fetched(spark.createDataFrame([], "url string")).count() == 0
