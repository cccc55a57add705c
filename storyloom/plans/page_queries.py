"""Queries over ``pages``: URLs, markup, identity and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BAD_IMAGE_ENDS, BAD_IMAGE_PARTS, HEADLINE_CATEGORIES, NAV_ENDS, NAV_PARTS, NAV_SLASHES, NON_ARTICLE_PARTS, NON_ARTICLE_STARTS, URL_CATEGORIES
from ..functions import markup as M, texts as X, urls as U
from ..operators import changes as C
from ..sources import feeds as S
from ..sources.tables import page_articles, table
from .registry import query

_any = lambda tests: "(" + " OR ".join(tests) + ")"
_q = lambda s: "'" + s.replace("'", "''") + "'"
_has = lambda col, parts: _any([f"contains({col}, {_q(p)})" for p in parts])
CANONICAL = "split_part(CASE WHEN b LIKE '%/' AND length(b) - length(replace(b, '/', '')) > 3 THEN rtrim(b, '/') ELSE b END, '?', 1)"
TITLE = "CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) END"
PAGES = f"p AS (SELECT page_id, url, html, split_part(url, '#', 1) AS b FROM pages), a AS (SELECT page_id, url, html, {CANONICAL} AS canonical, coalesce({TITLE}, '') AS headline FROM p)"
NAV = f"(ends_with(lower(url), '/') AND length(url) - length(replace(url, '/', '')) <= {NAV_SLASHES} OR {_any([f'ends_with(lower(url), {_q(e)})' for e in NAV_ENDS])} OR {_has('lower(url)', NAV_PARTS)})"
CATEGORY = "CASE " + " ".join(f"WHEN {_has('lower(url)', parts)} THEN '{name}'" for name, parts in URL_CATEGORIES) + " " + " ".join(f"WHEN {_has('lower(headline)', parts)} THEN '{name}'" for name, parts in HEADLINE_CATEGORIES) + " ELSE 'general' END"
STRIP = "trim(regexp_replace(replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', ''), '\\s+', ' ', 'g'))"


@query("x_canonical_url", f"WITH {PAGES} SELECT page_id, canonical FROM a")
def x_canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query("x_stable_id", f"WITH {PAGES} SELECT page_id, left(sha256(canonical), 16) AS id FROM a")
def x_stable_id(spark, d):
    return table(spark, d, "pages").select("page_id", U.stable_id(F.col("url")).alias("id"))


@query("x_domain", "SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS domain FROM pages")
def x_domain(spark, d):
    return table(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@query("x_favicon", "SELECT page_id, regexp_extract(url, '^((?:.*?://)?[^/]*)', 1) || '/favicon.ico' AS favicon FROM pages")
def x_favicon(spark, d):
    return table(spark, d, "pages").select("page_id", U.favicon(F.col("url")).alias("favicon"))


@query("x_norm_url", "SELECT page_id, 'https://' || regexp_replace(url, '^https?://', '') AS url FROM pages")
def x_norm_url(spark, d):
    return table(spark, d, "pages").select("page_id", U.absolute_url(F.regexp_replace("url", "^https?:(//)?", "")).alias("url"))


@query("x_slug_words", """
WITH s AS (SELECT page_id, split_part(list_filter(string_split(regexp_replace(url, '^(?:.*?://)?[^/]*', ''), '/'), lambda p: p <> '')[-1], '.', 1) AS slug FROM pages),
w AS (SELECT page_id, list_filter(regexp_split_to_array(coalesce(slug, ''), '[-_]'), lambda w: strlen(w) > 3 AND NOT regexp_matches(w, '^[0-9]+$')) AS ws FROM s)
SELECT page_id, CASE WHEN len(ws) >= 2 THEN array_to_string(ws, ' ') ELSE '' END AS slug FROM w""")
def x_slug_words(spark, d):
    return table(spark, d, "pages").select("page_id", U.slug_words(F.col("url")).alias("slug"))


@query("f_nav_link", f"SELECT page_id, {NAV} AS is_nav FROM pages")
def f_nav_link(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_nav_link(F.col("url")).alias("is_nav"))


@query("x_classify", f"WITH {PAGES} SELECT page_id, {CATEGORY} AS category FROM a")
def x_classify(spark, d):
    return page_articles(spark, d).select("page_id", "category")


@query("pages_by_category", f"WITH {PAGES}, c AS (SELECT {CATEGORY} AS category, canonical FROM a) SELECT category, count(*)::BIGINT AS n_pages, count(DISTINCT canonical)::BIGINT AS n_ids FROM c GROUP BY category")
def pages_by_category(spark, d):
    return page_articles(spark, d).groupBy("category").agg(F.count("*").alias("n_pages"), F.countDistinct("id").alias("n_ids"))


@query("x_page_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def x_page_title(spark, d):
    return table(spark, d, "pages").select("page_id", M.page_title(F.col("html")).alias("title"))


@query("x_strip_html", f"SELECT page_id, {STRIP} AS text FROM pages")
def x_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", M.strip_html(F.col("html")).alias("text"))


@query("x_snippet", f"""
WITH s AS (SELECT page_id, {STRIP} AS t FROM pages), c AS (SELECT page_id, CASE WHEN contains(t, 'The post ') THEN trim(split_part(t, 'The post ', 1)) ELSE t END AS t FROM s)
SELECT page_id, CASE WHEN strlen(t) > 500 THEN left(t, list_max(list_filter(range(125, 501), lambda n: strlen(left(t, n)) <= 500))) ELSE t END AS snippet FROM c""")
def x_snippet(spark, d):
    return table(spark, d, "pages").select("page_id", M.snippet(F.col("html")).alias("snippet"))


@query("x_xml_tag", "SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1)), '') AS p FROM pages")
def x_xml_tag(spark, d):
    return table(spark, d, "pages").select("page_id", M.xml_tag(F.col("html"), "p").alias("p"))


@query("x_attr", "SELECT page_id, CASE WHEN regexp_matches(html, '(?is)lang=\"[^\"]*\"') THEN regexp_extract(html, '(?is)lang=\"([^\"]*)\"', 1) WHEN regexp_matches(html, '(?is)lang=''[^'']*''') THEN regexp_extract(html, '(?is)lang=''([^'']*)''', 1) END AS lang FROM pages")
def x_attr(spark, d):
    return table(spark, d, "pages").select("page_id", M.attribute(F.col("html"), "lang").alias("lang"))


#: A page's head with pictures: by page_id mod 5 a good one, a sub-property before it, a picture that is none, only twitter's, none.
_HEAD = lambda: F.concat(F.lit("<head>"), F.element_at(F.array(*map(F.lit, (
    '<meta property="og:image" content="https://img.ex.com/ID.jpg">', '<meta property="og:image:width" content="https://no.ex.com/1.jpg"><meta content="https://img.ex.com/ID.jpg" property="og:image">',
    '<meta property="og:image" content="https://img.ex.com/spacer/ID.jpg">', '<META name="twitter:image" content="https://img.ex.com/ID.jpg">', ""))), (F.col("page_id") % 5 + 1).cast("int")), F.lit("</head>"))
_IMG = lambda: F.element_at(F.array(*map(F.lit, (
    '<img class="x" src="https://img.ex.com/ID.jpg">', '<img data-src="https://img.ex.com/ID.jpg" src="https://img.ex.com/other.jpg">', '<img src="//img.ex.com/ID.jpg">', '<img src="https://img.ex.com/1x1/ID.jpg"><img src="https://img.ex.com/ID.jpg">', "<p>none</p>"))), (F.col("page_id") % 5 + 1).cast("int"))
_own = lambda c: F.replace(c, F.lit("ID"), F.col("page_id").cast("string"))
_IMAGE = "'https://img.ex.com/' || page_id || '.jpg'"


@query("x_meta_image", f"SELECT page_id, CASE WHEN page_id % 5 IN (0, 1, 3) THEN {_IMAGE} END AS image FROM pages")
def x_meta_image(spark, d):
    return table(spark, d, "pages").select("page_id", M.meta_image(F.concat(_own(_HEAD()), "html")).alias("image"))


@query("x_extract_image", f"SELECT page_id, CASE WHEN page_id % 5 < 4 THEN {_IMAGE} END AS image FROM pages")
def x_extract_image(spark, d):
    return table(spark, d, "pages").select("page_id", M.extract_image(F.concat(_own(_IMG()), "html")).alias("image"))


@query("src_discover_link", "SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<link[^>]*alternate') THEN regexp_extract(html, 'href=\"([^\"]*)\"', 1) END AS feed FROM pages")
def src_discover_link(spark, d):
    return table(spark, d, "pages").select("page_id", M.feed_link(F.col("html"), F.col("url")).alias("feed"))


_FIRST, _SECOND = "First paragraph, which is long enough.", "Second paragraph, which is long enough too."
#: By page_id mod 3: two paragraphs in an article; a short one and two long ones; an article with one paragraph and a container of two.
_BODY = [f"<article><p>{_FIRST}</p><p>{_SECOND}</p></article>", f"<article><p>Short.</p><p>{_FIRST}</p><div><p>{_SECOND}</p></div></article>", f"<article><p>{_SECOND}</p></article><div class='article-body'><p>{_FIRST}</p><p>{_SECOND}</p></div>"]


@query("x_body_text", f"SELECT page_id, '{_FIRST}' || chr(10) || chr(10) || '{_SECOND}' AS body_text FROM pages")
def x_body_text(spark, d):
    """Each page behind an article of its own: the first container with two paragraphs counts."""
    lead = F.element_at(F.array(*map(F.lit, _BODY)), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", M.body_text(F.concat(lead, "html")).alias("body_text"))


@query("x_page_bodies")
def x_page_bodies(spark, d):
    """The article's text of each page as it is."""
    return table(spark, d, "pages").select("page_id", M.body_text(F.col("html")).alias("body_text"))


@query("src_autodetect", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'h3 a[href]' WHEN 1 THEN 'article a[href]' ELSE '.entry-title a[href]' END AS selector FROM pages")
def src_autodetect(spark, d):
    """Each page behind many links of one pattern, and as many that are too short or lead to sections."""
    link = "".join(f"<a href='/s/{k}.html'>Headline that is long {k}</a>" for k in range(60))
    noise = "".join(f"<h2><a href='/tag/{k}'>Section that is long {k}</a><a href='/s/x{k}.html'>Short</a></h2>" for k in range(90))
    kinds = [f"<h3>{link}</h3>", f"<article>{link}</article>", f"<p class='entry-title'>{link}</p>"]
    lead = F.element_at(F.array(*[F.lit(x + noise) for x in kinds]), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", M.article_link_pattern(F.concat(lead, "html")).alias("selector"))


@query("f_non_article", f"WITH {PAGES} SELECT page_id, {_has('lower(headline)', NON_ARTICLE_PARTS)} OR {_any([f'starts_with(lower(headline), {_q(s)})' for s in NON_ARTICLE_STARTS])} AS skip FROM a")
def f_non_article(spark, d):
    return page_articles(spark, d).select("page_id", X.is_non_article(F.col("headline")).alias("skip"))


@query("f_len_bounds", f"WITH {PAGES} SELECT page_id, strlen(headline) BETWEEN 10 AND 200 AS ok FROM a")
def f_len_bounds(spark, d):
    return page_articles(spark, d).select("page_id", X.within_bytes(F.col("headline"), 10, 200).alias("ok"))


@query("f_good_image", f"SELECT page_id, NOT ({_has('lower(url)', BAD_IMAGE_PARTS)} OR {_any([f'ends_with(lower(url), {_q(e)})' for e in BAD_IMAGE_ENDS])}) AS good FROM pages")
def f_good_image(spark, d):
    return table(spark, d, "pages").select("page_id", M.is_good_image(F.col("url")).alias("good"))


@query("x_resolve_image", "SELECT page_id, CASE WHEN starts_with(url, 'http') THEN trim(url) END AS image, 'https:' || regexp_replace(trim(url), '^https?:', '') AS bare FROM pages")
def x_resolve_image(spark, d):
    return table(spark, d, "pages").select("page_id", M.resolve_image(F.col("url")).alias("image"), M.resolve_image(F.regexp_replace("url", "^https?:", "")).alias("bare"))


@query("src_all", f"WITH {PAGES}, u AS (SELECT page_id, url, 0 AS rank FROM a UNION ALL SELECT page_id, canonical, 1 FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, page_id) AS n FROM u) SELECT page_id, url, rank FROM r WHERE n = 1")
def src_all(spark, d):
    pages = table(spark, d, "pages")
    both = pages.select("page_id", "url", F.lit(0).alias("rank")).unionByName(pages.select("page_id", U.canonical_url(F.col("url")).alias("url"), F.lit(1).alias("rank")))
    return S.keep_first(both, "url", "rank", "page_id")


@query("q_existing_ids", f"WITH {PAGES}, i AS (SELECT DISTINCT left(sha256(canonical), 16) AS id FROM a) SELECT id FROM i WHERE id IN (SELECT left(sha256(url), 16) FROM pages)")
def q_existing_ids(spark, d):
    pages = table(spark, d, "pages")
    return C.existing_ids(pages.select(U.stable_id(F.col("url")).alias("id")), pages.select(F.substring(F.sha2("url", 256), 1, 16).alias("id")))


@query("j_orphans", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT rtrim(url, '/') FROM pages WHERE url LIKE '%/') AND url LIKE '%/'")
def j_orphans(spark, d):
    pages = table(spark, d, "pages")
    bare = pages.filter(F.col("url").endswith("/")).select(F.rtrim("url", F.lit("/")).alias("url"))
    return pages.filter(F.col("url").endswith("/")).select("page_id", "url").join(bare, "url", "left_anti")
