"""Finding out how a site can be read, and reading each source by its method.

``fetched`` is what a fetcher brought: url, body (null if it failed).  Sites and their well-known paths are joined with it, so one
pass of a fetcher over ``wanted`` is all the network that discovery needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FEED_PATHS, SITEMAP_PATHS
from ..functions.markup import article_link_pattern, body_text, feed_link, meta_image, page_title
from ..functions.urls import absolute_url, origin
from .feeds import all_articles, feed_articles, page_links, sitemap_articles


def is_feed(body: Column) -> Column:
    """The text is an RSS, RDF or Atom document."""
    return F.coalesce(body.rlike(r"(?is)^\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<(rss|feed|rdf:RDF)[\s>]"), F.lit(False))


def is_news_sitemap(body: Column) -> Column:
    return F.coalesce(body.contains("<news:title"), F.lit(False))


def _paths(url: Column, paths: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(p) for p in paths]), lambda p: F.concat(F.rtrim(origin(url), F.lit("/")), p))


def wanted(sites: DataFrame) -> DataFrame:
    """sites: site, url -> site, url of everything that discovery may look at, the site's own page and the well-known paths."""
    own = absolute_url(F.col("url"))
    return sites.select("site", F.explode(F.concat(F.array(own), _paths(own, FEED_PATHS), _paths(own, SITEMAP_PATHS))).alias("url"))


def probe(sites: DataFrame, fetched: DataFrame, paths: list[str], holds) -> DataFrame:
    """site, found: the first of the well-known paths of each site whose text ``holds``; sites without one are left out."""
    asked = sites.select("site", F.posexplode(_paths(absolute_url(F.col("url")), paths)).alias("rank", "probe"))
    hits = asked.join(fetched.filter(holds(F.col("body"))).select(F.col("url").alias("probe")), "probe")
    return hits.groupBy("site").agg(F.min(F.struct("rank", "probe")).alias("m")).select("site", F.col("m.probe").alias("found"))


def probe_feeds(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    return probe(sites, fetched, FEED_PATHS, is_feed)


def probe_sitemaps(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    return probe(sites, fetched, SITEMAP_PATHS, is_news_sitemap)


def discover(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """site, method, scrape_url, scrape_config, title of each site; method is null where no way to read it was found.

    In this order: the page is a feed, it links to one, a well-known path is one, a well-known path is a news sitemap,
    the page has a pattern of links to articles.
    """
    own = absolute_url(F.col("url"))
    pages = sites.withColumn("own", own).join(fetched.select(F.col("url").alias("own"), "body"), "own", "left")
    linked = pages.withColumn("link", feed_link(F.col("body"), F.col("own")))
    known = fetched.filter(is_feed(F.col("body"))).select(F.col("url").alias("link"), F.lit(True).alias("link_is_feed"))
    rows = linked.join(known, "link", "left")
    rows = rows.join(probe_feeds(sites, fetched).withColumnRenamed("found", "feed_path"), "site", "left").join(probe_sitemaps(sites, fetched).withColumnRenamed("found", "sitemap_path"), "site", "left")
    direct = is_feed(F.col("body"))
    # A link that leads to no feed is an error, not a reason to look elsewhere.
    feed = F.when(direct, F.col("own")).when(F.col("link").isNotNull(), F.when(F.col("link_is_feed"), F.col("link"))).otherwise(F.col("feed_path"))
    stop = ~direct & F.col("link").isNotNull()
    pattern = F.when(feed.isNull() & ~stop & F.col("sitemap_path").isNull() & F.col("body").isNotNull(), article_link_pattern(F.col("body")))
    rows = rows.withColumns({"feed": feed, "stop": stop, "pattern": pattern})
    method = F.when(F.col("feed").isNotNull(), "rss").when(~F.col("stop") & F.col("sitemap_path").isNotNull(), "sitemap").when(F.col("pattern").isNotNull(), "html")
    place = F.coalesce("feed", F.when(~F.col("stop"), F.col("sitemap_path")), F.when(F.col("pattern").isNotNull(), F.col("own")))
    return rows.select("site", method.alias("method"), place.alias("scrape_url"), F.coalesce("pattern", F.lit("")).alias("scrape_config"), F.when(~direct, page_title(F.col("body"))).alias("title"))


def dispatch(files: DataFrame, as_of: Column) -> DataFrame:
    """files: publisher_id, language, method, body and the columns of ``page_links`` -> the raw articles of all methods; an unknown method is a feed."""
    of = lambda m: files.filter((F.col("method") == m) & F.col("body").isNotNull())
    other = files.filter((~F.coalesce(F.col("method"), F.lit("")).isin("sitemap", "html")) & F.col("body").isNotNull())
    return feed_articles(other, as_of).unionByName(sitemap_articles(of("sitemap"), as_of)).unionByName(page_links(of("html"), as_of))


def failed_sources(files: DataFrame) -> DataFrame:
    """publisher_id of the sources that brought nothing that can be read."""
    broken = F.col("body").isNull() | ((~F.coalesce(F.col("method"), F.lit("")).isin("sitemap", "html")) & ~is_feed(F.col("body")))
    return files.filter(broken).select("publisher_id").distinct()


def scrape_all(fixed: DataFrame, custom: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(articles, failed sources): fixed sources before custom ones, the first article of each URL."""
    return all_articles(dispatch(fixed, as_of), dispatch(custom, as_of)), failed_sources(fixed.select("publisher_id", "method", "body").unionByName(custom.select("publisher_id", "method", "body")))


def bodies(articles: DataFrame, fetched: DataFrame) -> DataFrame:
    """id, body_text, image_url: the stored body where there is one, else what the fetched page gives; pages are read for the others only."""
    missing = F.coalesce(F.col("body_text"), F.lit("")) == ""
    stored = articles.filter(~missing).select("id", "body_text", "image_url")
    pages = articles.filter(missing).select("id", F.col("original_url").alias("url")).join(fetched.select("url", "body"), "url", "left")
    empty = F.lit("")
    fresh = pages.select("id", F.when(F.col("body").isNull(), empty).otherwise(body_text(F.col("body"))).alias("body_text"), F.coalesce(meta_image(F.left("body", F.lit(100_000))), empty).alias("image_url"))
    return stored.unionByName(fresh)
