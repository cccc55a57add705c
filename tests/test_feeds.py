"""Feeds of three kinds as real sites write them."""

from pyspark.sql import functions as F

from storyloom.sources.feeds import feed_articles

RSS = """﻿
<?xml version="1.0" encoding="UTF-8"?><!-- made by hand -->
<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Site</title>
<item><title><![CDATA[A </item> & more]]></title><link> https://ex.com/1 </link><pubDate>Tue, 09 Jan 2024 10:00:00 +0000</pubDate><description>&lt;p&gt;Text &amp;amp; more&lt;/p&gt; The post A appeared first on Site</description><media:thumbnail url="https://img.ex.com/1.jpg"/></item>
<item><title>GMT</title><link>https://ex.com/2</link><pubDate>Tue, 09 Jan 2024 11:00:00 GMT</pubDate><content:encoded><![CDATA[<p>x</p><img src="https://img.ex.com/2.jpg">]]></content:encoded></item>
<item><title>Old</title><link>https://ex.com/old</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>
<item><title> </title><link>https://ex.com/none</link></item><item><title>No link</title></item>
<item><title>Dublin</title><link>https://ex.com/3</link><dc:date>2024-01-09T12:00:00Z</dc:date><enclosure url="https://img.ex.com/3.jpg" type="image/jpeg"/></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title type="html">At &lt;b&gt;om</title><link rel="self" href="https://ex.com/self"/><link rel="alternate" href="https://ex.com/4"/><updated>2024-01-09T00:00:00Z</updated><summary>Sum</summary></entry>
<entry><title>Only self</title><link rel="self" href="https://ex.com/5"/></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d"><channel><title>c</title></channel><item rdf:about="u"><title>R</title><link>https://ex.com/6</link><dc:date>2024-01-09</dc:date></item></rdf:RDF>"""
BROKEN = "<rss><channel><item><title>x &nbsp; y &amp; z</title><link>https://ex.com/7</link></item><item><title>tail</title><link>https://ex.com/8</link></item>"


def test_kinds(spark):
    bodies = [("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("broken", BROKEN), ("empty", ""), ("null", None), ("text", "no xml"), ("html", "<html><body><p>x</body></html>")]
    files = spark.createDataFrame([(k, "en", b) for k, b in bodies], "publisher_id string, language string, body string")
    got = {r.original_url: r for r in feed_articles(files, F.lit("2024-01-10 00:00:00").cast("timestamp")).collect()}
    heads = {k.rsplit("/", 1)[1]: r.headline for k, r in got.items()}
    assert heads == {"1": "A </item> & more", "2": "GMT", "3": "Dublin", "4": "At <b>om", "5": "Only self", "6": "R", "7": "x   y & z", "8": "tail"}
    assert got["https://ex.com/1"].image_url == "https://img.ex.com/1.jpg" and got["https://ex.com/1"].snippet.startswith("Text") and "The post" not in got["https://ex.com/1"].snippet
    assert got["https://ex.com/2"].image_url == "https://img.ex.com/2.jpg" and got["https://ex.com/3"].image_url == "https://img.ex.com/3.jpg"
    assert [got[f"https://ex.com/{k}"].published_at[:16] for k in (1, 2, 3, 4, 5, 6)] == ["2024-01-09T10:00", "2024-01-09T11:00", "2024-01-09T12:00", "2024-01-09T00:00", "2024-01-10T00:00", "2024-01-09T00:00"]
