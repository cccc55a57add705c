"""Queries over sources: feeds, sitemaps, front pages and discovery, on files built from ``pages``.

Each file is text that a site could serve, made from ids and URLs of the pages, so that SQL can say what must be read from it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources import discover as D, feeds as S
from ..sources.tables import table
from .registry import query

#: The time of the fetch.
AS_OF = "2024-01-10 00:00:00"
_as_of = lambda: F.lit(AS_OF).cast("timestamp")
_hours = lambda: F.pmod("page_id", F.lit(96))
_when = lambda: _as_of() - F.make_dt_interval(F.lit(0), _hours().cast("int"))
_sum = lambda item, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("x")))), lambda v: v["x"]), "")
_group = lambda: F.concat(F.lit("site"), F.pmod("page_id", F.lit(10)).cast("string"))
_EMPTY = ("article_sel", "headline_sel", "image_sel", "link_attr", "base_url")


def feed_files(spark, d):
    """RSS: every third entry undated, the others up to 95 hours old; titles and summaries hold entities and markup."""
    date = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("<pubDate>"), F.date_format(_when(), "EEE, dd MMM yyyy HH:mm:ss Z"), F.lit("</pubDate>")))
    item = F.concat(
        F.lit("<item><title>Story &amp; more "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link>"), date,
        F.lit("<description>&lt;p&gt;Text of "), F.col("page_id").cast("string"), F.lit("&lt;/p&gt; The post Story appeared first</description>"),
        F.lit("<media:thumbnail url=\"https://img.ex.com/"), F.col("page_id").cast("string"), F.lit(".jpg\"/></item>"),
    )
    files = table(spark, d, "pages").groupBy(_group().alias("publisher_id")).agg(_sum(item, "page_id").alias("x"))
    return files.select("publisher_id", F.lit("en").alias("language"), F.concat(F.lit("<?xml version=\"1.0\"?><rss version=\"2.0\" xmlns:media=\"http://search.yahoo.com/mrss/\"><channel>"), "x", F.lit("</channel></rss>")).alias("body"))


def sitemap_files(spark, d):
    """News sitemap: dates with a time, without one, and none; titles too short and titles that are no articles."""
    k = F.col("page_id") % 5
    date = F.when(k == 1, F.date_format(_when(), "yyyy-MM-dd")).when(k == 2, "").otherwise(F.date_format(_when(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    title = F.when(k == 3, "Short").when(k == 4, F.concat(F.lit("Crossword number "), "page_id")).otherwise(F.concat(F.lit("Headline &quot;number&quot; "), F.col("page_id").cast("string")))
    item = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><news:news><news:publication_date>"), date, F.lit("</news:publication_date><news:title>"), title, F.lit("</news:title></news:news></url>"))
    files = table(spark, d, "pages").groupBy(_group().alias("publisher_id")).agg(_sum(item, "page_id").alias("x"))
    return files.select("publisher_id", F.lit("en").alias("language"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("body"))


def front_files(spark, d):
    """Front pages: every link twice, links of sections, relative links and texts that are too short."""
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    href = F.when(k == 0, F.concat(F.lit("/story/"), n, F.lit(".html"))).when(k == 1, F.concat(F.lit("https://other.ex.com/tag/"), n)).otherwise(F.concat(F.lit("https://other.ex.com/story/"), n, F.lit(".html")))
    text = F.when(k == 3, "Tiny").otherwise(F.concat(F.lit("Front headline of page "), n))
    link = F.concat(F.lit("<div class=\"n\"><h3>"), text, F.lit("</h3><a href=\""), href, F.lit("\">more to read here</a></div>"))
    files = table(spark, d, "pages").groupBy(_group().alias("publisher_id")).agg(_sum(F.concat(link, link), "page_id").alias("x"))
    files = files.select("publisher_id", F.lit("en").alias("language"), F.concat(F.lit("<html><body>"), "x", F.lit("</body></html>")).alias("body"))
    return files.withColumns({"article_sel": F.lit("div.n a[href]"), "headline_sel": F.lit(""), "image_sel": F.lit(""), "link_attr": F.lit("href"), "base_url": F.lit("https://ex.com")})


_SITE = "'site' || (page_id % 10)"
_DATE = f"TIMESTAMP '{AS_OF}' - to_hours((page_id % 96)::BIGINT)"
_RFC = lambda t: f"strftime({t}, '%Y-%m-%dT%H:%M:%S') || 'Z'"
_ID = "left(sha256(split_part(CASE WHEN b LIKE '%/' AND length(b) - length(replace(b, '/', '')) > 3 THEN rtrim(b, '/') ELSE b END, '?', 1)), 16)"
_POS = "(row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) - 1)::INT"
RSS = f"""rss AS (SELECT {_ID} AS id, {_SITE} AS publisher_id, url AS original_url, 'Story & more ' || page_id AS headline, 'Text of ' || page_id AS snippet, 'https://img.ex.com/' || page_id || '.jpg' AS image_url,
  {_RFC(f"CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '{AS_OF}' ELSE {_DATE} END")} AS published_at, {_POS} AS pos, page_id FROM (SELECT *, split_part(url, '#', 1) AS b FROM pages))"""
RSS_KEEP = "page_id % 3 = 0 OR page_id % 96 <= 48"
MAP = f"""map AS (SELECT {_ID} AS id, {_SITE} AS publisher_id, url AS original_url, 'Headline "number" ' || page_id AS headline, '' AS snippet, '' AS image_url,
  {_RFC(f"CASE WHEN page_id % 5 = 1 THEN date_trunc('day', {_DATE}) ELSE {_DATE} END")} AS published_at, {_POS} AS pos, page_id, CASE WHEN page_id % 5 = 1 THEN date_trunc('day', {_DATE}) ELSE {_DATE} END AS ts FROM (SELECT *, split_part(url, '#', 1) AS b FROM pages))"""
MAP_KEEP = f"page_id % 5 IN (0, 1) AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR"
_HREF = "CASE WHEN page_id % 4 = 0 THEN 'https://ex.com/story/' || page_id || '.html' ELSE 'https://other.ex.com/story/' || page_id || '.html' END"
FRONT = f"""front AS (SELECT left(sha256({_HREF}), 16) AS id, {_SITE} AS publisher_id, {_HREF} AS original_url, 'more to read here' AS headline, '' AS snippet, '' AS image_url,
  {_RFC(f"TIMESTAMP '{AS_OF}'")} AS published_at, (2 * (row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) - 1))::INT AS pos, page_id FROM pages)"""
FRONT_KEEP = "page_id % 4 <> 1"
_OUT = ["id", "publisher_id", "original_url", "headline", "snippet", "image_url", "published_at", "pos"]
_COLS = ", ".join(_OUT)


@query("src_rss", f"WITH {RSS} SELECT {_COLS} FROM rss WHERE {RSS_KEEP}")
def src_rss(spark, d):
    return S.feed_articles(feed_files(spark, d), _as_of()).select(*_OUT)


@query("src_sitemap", f"WITH {MAP} SELECT {_COLS} FROM map WHERE {MAP_KEEP}")
def src_sitemap(spark, d):
    return S.sitemap_articles(sitemap_files(spark, d), _as_of()).select(*_OUT)


@query("src_sitemap_custom", f"WITH {MAP} SELECT {_COLS}, 'en' AS language FROM map WHERE {MAP_KEEP} AND page_id % 5 <> 1")
def src_sitemap_custom(spark, d):
    """Sitemaps of added sources: entries whose date has no time are left out, and the language is fixed."""
    files = sitemap_files(spark, d).withColumn("language", F.lit("en"))
    return S.sitemap_articles(files, _as_of(), date_only=False).select(*_OUT, "language")


@query("src_html", f"WITH {FRONT} SELECT {_COLS} FROM front WHERE {FRONT_KEEP}")
def src_html(spark, d):
    return S.page_links(front_files(spark, d), _as_of()).select(*_OUT)


def _files(spark, d):
    of = lambda df, m: df.withColumn("publisher_id", F.concat(F.lit(f"{m}-"), "publisher_id")).withColumn("method", F.lit(m))
    feeds, maps = (of(df, m).withColumns({c: F.lit("") for c in _EMPTY}) for df, m in ((feed_files(spark, d), "rss"), (sitemap_files(spark, d), "sitemap")))
    broken = table(spark, d, "pages").select(F.concat(F.lit("down"), F.col("page_id").cast("string")).alias("publisher_id"), F.lit("en").alias("language"), F.when(F.col("page_id") % 2 == 0, "<html>not a feed</html>").alias("body"), F.lit("rss").alias("method")).withColumns({c: F.lit("") for c in _EMPTY})
    return feeds.unionByName(maps).unionByName(of(front_files(spark, d), "html")).unionByName(broken)


_ALL = f"""WITH {RSS}, {MAP}, {FRONT}, u AS (SELECT 'rss-' || publisher_id AS publisher_id, {', '.join(c for c in _OUT if c != 'publisher_id')} FROM rss WHERE {RSS_KEEP}
  UNION ALL SELECT 'sitemap-' || publisher_id, {', '.join(c for c in _OUT if c != 'publisher_id')} FROM map WHERE {MAP_KEEP} UNION ALL SELECT 'html-' || publisher_id, {', '.join(c for c in _OUT if c != 'publisher_id')} FROM front WHERE {FRONT_KEEP})"""


@query("src_dispatch", f"{_ALL} SELECT {_COLS} FROM u")
def src_dispatch(spark, d):
    return D.dispatch(_files(spark, d), _as_of()).select(*_OUT)


@query("src_scrape_all", f"{_ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY original_url ORDER BY publisher_id, pos) AS n FROM u) SELECT original_url, publisher_id, pos FROM r WHERE n = 1")
def src_scrape_all(spark, d):
    files = _files(spark, d)
    return D.scrape_all(files, files.limit(0), _as_of())[0].select("original_url", "publisher_id", "pos")


@query("src_failed", "SELECT 'down' || page_id AS publisher_id FROM pages")
def src_failed(spark, d):
    files = _files(spark, d)
    return D.scrape_all(files, files.limit(0), _as_of())[1]


def _sites(spark, d):
    return table(spark, d, "pages").select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("site"), F.concat(F.when(F.col("page_id") % 2 == 0, "https://").otherwise(""), F.lit("s"), F.col("page_id").cast("string"), F.lit(".ex.com/news")).alias("url"), "page_id")


FEED_BODY = "<?xml version=\"1.0\"?><rss><channel></channel></rss>"
MAP_BODY = "<urlset><url><news:title>x</news:title></url></urlset>"


def _fetched(spark, d):
    """By page_id mod 6: a feed; a page that links to one; one with feeds at two well-known paths; with a sitemap; with links only; with nothing.  Mod 12 = 1: the link leads nowhere."""
    k = F.col("page_id") % 6
    own = F.concat(F.lit("https://s"), F.col("page_id").cast("string"), F.lit(".ex.com"))
    title = F.concat(F.lit("<html><head><title>Site "), F.col("page_id").cast("string"), F.lit("</title>"))
    links = "".join(f"<h2><a href='/a/{i}.html'>A headline that is long {i}</a></h2>" for i in range(4))
    page = F.when(k == 0, FEED_BODY).when(k == 1, F.concat(title, F.lit("<link rel='alternate' type='application/rss+xml' href='/my.xml'></head></html>"))).when(k == 4, F.concat(title, F.lit(f"</head><body>{links}</body></html>"))).otherwise(F.concat(title, F.lit("</head><body><p>x</p></body></html>")))
    entry = lambda path, body: F.struct(F.concat(own, F.lit(path)).alias("url"), body.alias("body"))
    feed, none = F.lit(FEED_BODY), F.lit("<html>nothing</html>")
    more = F.when(F.col("page_id") % 12 == 7, F.array(entry("/my.xml", feed))).when(k == 2, F.array(entry("/atom.xml", feed), entry("/rss.xml", feed), entry("/feed", none))).when(k == 3, F.array(entry("/feed", none), entry("/sitemap.xml", F.lit(MAP_BODY)), entry("/sitemap_news.xml", none)))
    both = F.concat(F.array(entry("/news", page)), F.coalesce(more, F.expr("cast(array() as array<struct<url:string,body:string>>)")))
    return table(spark, d, "pages").select(F.explode(both).alias("f")).select("f.url", "f.body")


_S = "'s' || page_id"
_O = "'https://s' || page_id || '.ex.com'"


@query("src_probe_feed", f"SELECT {_S} AS site, {_O} || '/rss.xml' AS found FROM pages WHERE page_id % 6 = 2")
def src_probe_feed(spark, d):
    return D.probe_feeds(_sites(spark, d), _fetched(spark, d))


@query("src_probe_sitemap", f"SELECT {_S} AS site, {_O} || '/sitemap.xml' AS found FROM pages WHERE page_id % 6 = 3")
def src_probe_sitemap(spark, d):
    return D.probe_sitemaps(_sites(spark, d), _fetched(spark, d))


@query("src_discover", f"""SELECT {_S} AS site, CASE WHEN page_id % 6 IN (0, 2) OR page_id % 12 = 7 THEN 'rss' WHEN page_id % 6 = 3 THEN 'sitemap' WHEN page_id % 6 = 4 THEN 'html' END AS method,
  {_O} || CASE WHEN page_id % 6 IN (0, 4) THEN '/news' WHEN page_id % 12 = 7 THEN '/my.xml' WHEN page_id % 6 = 2 THEN '/rss.xml' WHEN page_id % 6 = 3 THEN '/sitemap.xml' END AS scrape_url,
  CASE WHEN page_id % 6 = 4 THEN 'h2 a[href]' ELSE '' END AS scrape_config, CASE WHEN page_id % 6 <> 0 THEN 'Site ' || page_id END AS title FROM pages""")
def src_discover(spark, d):
    return D.discover(_sites(spark, d), _fetched(spark, d))


@query("src_body", """SELECT 'a' || page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'stored' WHEN page_id % 3 = 1 THEN 'First paragraph of page ' || page_id || ', long enough.' || chr(10) || chr(10) || 'Second paragraph, which is long enough as well.' ELSE '' END AS body_text,
  CASE WHEN page_id % 3 = 0 THEN 'kept.jpg' WHEN page_id % 3 = 1 THEN 'https://img.ex.com/' || page_id || '.jpg' ELSE '' END AS image_url FROM pages""")
def src_body(spark, d):
    n = F.col("page_id").cast("string")
    art = table(spark, d, "pages").select("page_id", F.concat(F.lit("a"), n).alias("id"), F.concat(F.lit("https://ex.com/"), n).alias("original_url"), F.when(F.col("page_id") % 3 == 0, "stored").otherwise("").alias("body_text"), F.when(F.col("page_id") % 3 == 0, "kept.jpg").otherwise("").alias("image_url"))
    html = F.concat(F.lit("<html><head><meta property=\"og:image\" content=\"https://img.ex.com/"), n, F.lit(".jpg\"></head><body><article><p>First paragraph of page "), n, F.lit(", long enough.</p><p>Second paragraph, which is long enough as well.</p><p>Short.</p></article></body></html>"))
    fetched = table(spark, d, "pages").select(F.concat(F.lit("https://ex.com/"), n).alias("url"), F.when(F.col("page_id") % 3 == 2, F.lit(None)).otherwise(html).alias("body"))
    return D.bodies(art, fetched)


@query("s_publisher_name", "SELECT row_number() OVER (ORDER BY name COLLATE de, doc_id)::INT AS n, 'd' || doc_id AS id, name FROM (SELECT doc_id, regexp_extract(text, '\\p{L}+ \\p{L}+') AS name FROM documents)")
def s_publisher_name(spark, d):
    """A source for each document, named by its first two words in a row: by name in the order of letters (case and accents last), then by id."""
    from ..intermediate import numbered

    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.regexp_extract("text", r"\p{L}+ \p{L}+", 0).alias("name"))
    return numbered(S.by_name(docs), "n", "by_name", "doc_id").select("n", "id", "name")


def _marked(texts: list[str]) -> list[str | None]:
    """Stands for a translation service: it has no answer for texts that begin with a capital E."""
    return [None if t.startswith("E") else f"[en] {t}" for t in texts]


@query("u_translate", "SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' OR text IS NULL OR text LIKE 'E%' THEN text ELSE '[en] ' || text END AS text, lang FROM documents")
def u_translate(spark, d):
    """Whole documents through the translation hook in batches of 32; a text without an answer stays as it is."""
    from ..operators.translation import translated

    return translated(table(spark, d, "documents").select("doc_id", "text", "lang"), ["text"], _marked)
