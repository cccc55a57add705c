"""Golden vectors of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions import markup as M, texts as X, urls as U


def column(spark, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("v")).alias("x")).collect()]


def test_canonical_url_and_id(spark):
    urls = ["https://ex.com/a/b", "https://ex.com/a/b/", "https://ex.com/a/b#top", "https://ex.com/a/b?utm_source=x", "https://ex.com/a/b/?utm_source=x", "https://ex.com/", "https://ex.com/a//"]
    assert column(spark, urls, U.canonical_url) == ["https://ex.com/a/b"] * 4 + ["https://ex.com/a/b/", "https://ex.com/", "https://ex.com/a"]
    assert column(spark, urls, U.stable_id) == ["dda5bc32ae3c10aa"] * 4 + ["36712827a4ed1abb", "0556d990b9b29231", "93f1f24c9eb2f35f"]


def test_normalize_numbers(spark):
    given = ["4,000", "4k", "€22m", "1.5m", "1,2,3", "4kk", "100m sprint"]
    assert column(spark, given, X.normalize_numbers) == ["4000", "4000", "€22000000", "1.5000000", "123", "4kk", "100000000 sprint"]


@pytest.mark.parametrize(
    "headline, expected",
    [
        ("PN leader Grech slams €22m Enemalta deal", "pn:2 leader:1 grech:2 slams:1 22000000:3 enemalta:2 deal:1 22000000_enemalta:3"),
        ("Abela says budget will help families", "abela:2 budget:1 help:1 families:1"),
        ("'Shocking' fire in Mdina kills 4,000 bees", "shocking:2 fire:1 mdina:2 kills:1 4000:3 bees:1"),
        ("COVID19 cases rise", "covid19:2 cases:1 rise:1"),
        ("", ""),
    ],
)
def test_tokens(spark, headline, expected):
    got = column(spark, [headline], X.tokens)[0]
    assert " ".join(f"{t['word']}:{t['weight']}" for t in got) == expected


def test_hours(spark):
    pairs = [("2026-02-28T00:00:00Z", "2026-03-01T00:00:00Z", 82.5), ("2026-01-31T23:00:00Z", "2026-02-01T00:00:00Z", 12.5), ("2025-12-31T23:00:00Z", "2026-01-01T00:00:00Z", 12.5), ("2026-04-10T05:00:00Z", "2026-04-12T05:00:00Z", 48.0), ("x", "x", 0.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, e double").select(X.hours_between(F.col("a"), F.col("b")).alias("h"), "e").collect()
    assert all(r.h == r.e for r in rows)


def test_shuffle(spark):
    rows = spark.createDataFrame([("story-1", 3)], "id string, n int")
    got = rows.select(X.shuffle_score(F.col("id"), 0, F.col("n")).alias("a"), X.shuffle_score(F.col("id"), 1, F.col("n")).alias("b")).first()
    assert abs(got.a - 2.3002943611) < 1e-9 and abs(got.b - 2.9702943611) < 1e-9


def test_markup(spark):
    assert column(spark, ["a<b <c>d> e", "x<p", None], M.strip_html) == ["ad e", "x", None]
    assert column(spark, ["<img src='data:x'><img alt=1 data-src=\"//c.d/e.jpg\">", '<img srcset="https://a/1.jpg 1x, https://a/2.jpg 2x">', "<p>"], M.extract_image) == ["https://c.d/e.jpg", "https://a/2.jpg", None]
    assert column(spark, ['<meta property="og:image" content="https://a/b.png"><meta name="twitter:image" content="https://t/u.png">', "<meta name='twitter:image' content=https://t/u.png>"], M.meta_image) == ["https://a/b.png", "https://t/u.png"]
    assert column(spark, ["&amp;lt; &ndash; &nope; &amp"], M.decode_entities) == ["&lt; – &nope; &amp"]
    assert column(spark, ["<t><loc> <![CDATA[x]]> </loc></t>", "<t></t>"], lambda c: M.xml_tag(c, "loc")) == ["x", None]
    assert column(spark, ['<link rel="alternate" type="application/rss+xml" href="/f.xml">'], lambda c: M.feed_link(c, F.lit("https://a.b/c/d"))) == ["https://a.b/f.xml"]
    assert column(spark, ["é" * 300, "abc"], lambda c: M.byte_prefix(c, 500)) == ["é" * 250, "abc"]


def test_body_and_patterns():
    long = "word " * 10
    assert M.body_of(f"<article><p>{long}</p><p>{long}</p><p>no</p></article>") == f"{long.strip()}\n\n{long.strip()}"
    assert M.body_of("<p>short</p>") == ""
    page = "".join(f'<h2><a href="https://x.y/a/{k}/story">A headline of some length</a></h2>' for k in range(3))
    assert M.best_link_pattern(page) == "h2 a[href]"


def test_category_and_slug(spark):
    assert column(spark, ["https://tvmnews.mt/x", "https://a.b/c", "https://blog.a/x"], lambda c: U.classify(c, F.lit("Bill vote"))) == ["entertainment", "politics", "opinion"]
    assert column(spark, ["https://a.b/c/man-bites-dogs-2024.html?x=1", "https://a.b/", "https://a.b"], U.slug_words) == ["bites dogs", "", ""]


def test_summary(spark):
    a = "The quick brown foxes jumped over fences. Another sentence follows about economics today."
    rows = spark.createDataFrame([([a, "The quick brown foxes jumped over hedges. Something entirely different happened yesterday."],), ([a],), ([],)], "b array<string>")
    got = [r[0] for r in rows.select(X.combined_summary(F.col("b"))).collect()]
    assert got == [a + " Something entirely different happened yesterday.", a, ""]
