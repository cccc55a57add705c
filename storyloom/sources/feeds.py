"""Readers: files of feeds, sitemaps and front pages to raw articles.

Fetching is a separate concern: these take a DataFrame of fetched files (publisher_id, language, body), so they run over
``spark.read.text(..., wholetext=True)``, ``binaryFile`` or any table.  ``as_of`` stands for the time of the fetch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import HEADLINE_BYTES, INGEST_HOURS
from ..functions.markup import _nav, attribute, decode_entities, extract_image, feed_image, parse_html, select_nodes, snippet, xml_tag
from ..functions.texts import is_non_article, within_bytes
from ..functions.urls import stable_id

RAW = "id string, publisher_id string, original_url string, headline string, translated_headline string, snippet string, body_text string, image_url string, language string, published_at string, category string, pos int"


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("published_at")


def _raw(rows: DataFrame, url: Column, headline: Column, snip: Column, image: Column, published: Column) -> DataFrame:
    blank = F.lit("")
    return rows.select(
        stable_id(url).alias("id"), "publisher_id", url.alias("original_url"), headline.alias("headline"), blank.alias("translated_headline"), snip.alias("snippet"), blank.alias("body_text"),
        F.coalesce(image, blank).alias("image_url"), "language", published.alias("published_at"), blank.alias("category"), "pos",
    )


_VALUES, _URLS = "array<struct<_VALUE: string>>", "array<struct<_url: string, _type: string>>"
_ENTRY = ", ".join(
    [f"`{n}`: {_VALUES}" for n in ("title", "pubDate", "published", "updated", "dc:date", "description", "summary")]
    + ["link: array<struct<_VALUE: string, _href: string, _rel: string>>", "`content:encoded`: array<string>", "content: array<string>", f"`media:content`: {_URLS}", f"`media:thumbnail`: {_URLS}", f"enclosure: {_URLS}", f"`media:group`: array<struct<`media:content`: {_URLS}, `media:thumbnail`: {_URLS}>>"]
)
#: RSS has its items in the channel, RDF beside it, Atom has entries.
_FEED = f"channel struct<item: array<struct<{_ENTRY}>>>, item array<struct<{_ENTRY}>>, entry array<struct<{_ENTRY}>>, _corrupt_record string"


def _first(values: Column) -> Column:
    """The first element; null if there is none."""
    return F.get(values, F.lit(0))


def _parsed_entries(body: Column) -> Column:
    """array of entries (title, link, date, summary, content, media, enclosed) of a body that is well-formed XML; empty if it is not."""
    feed = F.from_xml(F.regexp_replace(body, r"^[\s\uFEFF]+", ""), _FEED)
    none = F.array().cast(f"array<struct<{_ENTRY}>>")
    every = F.when(feed["_corrupt_record"].isNull(), F.concat(*[F.coalesce(x, none) for x in (feed["channel"]["item"], feed["item"], feed["entry"])])).otherwise(none)

    def entry(x: Column) -> Column:
        value = lambda n: F.nullif(F.btrim(_first(x[n])["_VALUE"]), F.lit(""))
        # A link without a relation is the page itself, as "alternate" is; others (self, enclosure) only where neither is there.
        place = lambda link: F.nullif(F.btrim(F.coalesce(link["_href"], link["_VALUE"])), F.lit(""))
        own = F.filter(x["link"], lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate")
        enclosed = _first(F.filter(x["enclosure"], lambda e: e["_type"].startswith("image/")))
        group = _first(x["media:group"])
        media = [_first(m)["_url"] for m in (x["media:content"], x["media:thumbnail"], group["media:content"], group["media:thumbnail"])]
        return F.struct(
            value("title").alias("title"), F.coalesce(place(_first(own)), place(_first(x["link"]))).alias("link"), F.coalesce(*[value(n) for n in ("pubDate", "published", "updated", "dc:date")]).alias("date"),
            F.coalesce(value("description"), value("summary"), F.lit("")).alias("summary"), F.coalesce(_first(x["content:encoded"]), _first(x["content"]), F.lit("")).alias("content"), F.coalesce(*media).alias("media"), enclosed["_url"].alias("enclosed"),
        )

    return F.transform(every, entry)


def _cut_entries(body: Column) -> Column:
    """The same from a body that no parser reads: entries by their tags."""

    def entry(x: Column) -> Column:
        enclosure = F.regexp_extract(x, r"(?s)(<enclosure[^>]*>)", 1)
        return F.struct(
            F.btrim(decode_entities(xml_tag(x, "title"))).alias("title"), F.coalesce(F.nullif(xml_tag(x, "link"), F.lit("")), attribute(F.regexp_extract(x, r"(?s)(<link\s[^>]*>)", 1), "href")).alias("link"),
            F.coalesce(*[xml_tag(x, t) for t in ("pubDate", "published", "updated", "dc:date")]).alias("date"), F.coalesce(decode_entities(F.coalesce(xml_tag(x, "description"), xml_tag(x, "summary"))), F.lit("")).alias("summary"),
            decode_entities(F.coalesce(xml_tag(x, "content"), F.lit(""))).alias("content"), attribute(F.regexp_extract(x, r"(?s)(<media:(?:content|thumbnail)[^>]*>)", 1), "url").alias("media"),
            F.when(attribute(enclosure, "type").startswith("image/"), attribute(enclosure, "url")).alias("enclosed"),
        )

    return F.transform(F.regexp_extract_all(body, F.lit(r"(?s)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), F.lit(1)), entry)


def feed_articles(files: DataFrame, as_of: Column) -> DataFrame:
    """RSS, RDF and Atom entries with a title and a link; dated ones no older than 48 hours, undated ones stamped ``as_of``.

    Bodies are parsed as XML: namespaces, CDATA (whatever tags it holds) and relations of links are read as they are meant.  A body that is
    not well-formed is cut at its tags.
    """
    parsed = files.select("publisher_id", "language", "body", _parsed_entries(F.col("body")).alias("parsed"))
    entries = parsed.select("publisher_id", "language", F.posexplode(F.when(F.size("parsed") > 0, F.col("parsed")).otherwise(_cut_entries(F.col("body")))).alias("pos", "x")).select("publisher_id", "language", "pos", "x.*")
    when = F.coalesce(F.try_to_timestamp("date"), F.try_to_timestamp(F.regexp_replace("date", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace("date", "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z")))
    rows = entries.withColumns({"ts": when, "image": feed_image(F.col("content"), F.col("media"), F.col("enclosed"), F.col("summary"))})
    rows = rows.filter((F.col("title") != "") & F.col("link").isNotNull() & (F.col("ts").isNull() | (F.col("ts") >= as_of - F.expr(f"INTERVAL {INGEST_HOURS} HOURS"))))
    return _raw(rows, F.col("link"), F.col("title"), snippet(F.col("summary")), F.col("image"), rfc3339(F.coalesce("ts", as_of)))


def sitemap_articles(files: DataFrame, as_of: Column, date_only: bool = True) -> DataFrame:
    """News sitemap entries; ones without a readable date or older than 48 hours are left out.  ``date_only``: dates without a time count as midnight."""
    blocks = files.select("publisher_id", "language", F.posexplode(F.slice(F.split("body", "<url>"), F.lit(2), F.size(F.split("body", "<url>")))).alias("pos", "b"))
    b = F.split_part("b", F.lit("</url>"), F.lit(1))
    date = xml_tag(b, "news:publication_date")
    when = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ].*(?:[Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(date))
    when = F.coalesce(when, F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(date))) if date_only else when
    rows = blocks.withColumns({"url": xml_tag(b, "loc"), "title": decode_entities(xml_tag(b, "news:title")), "ts": when, "image": xml_tag(b, "image:loc")})
    rows = rows.filter(F.col("url").isNotNull() & within_bytes(F.col("title"), HEADLINE_BYTES[0]) & ~is_non_article(F.col("title")) & (F.col("ts") >= as_of - F.expr(f"INTERVAL {INGEST_HOURS} HOURS")))
    return _raw(rows, F.col("url"), F.col("title"), F.lit(""), F.col("image"), rfc3339(F.col("ts")))


def page_links(files: DataFrame, as_of: Column) -> DataFrame:
    """Links of front pages by CSS patterns; files also has article_sel, headline_sel, image_sel, link_attr and base_url."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                seen: set[str] = set()
                for pos, node in enumerate(select_nodes(parse_html(f.body), f.article_sel)):
                    href = node.attrs.get(f.link_attr)
                    url = href if href and href.startswith("http") else f.base_url + href if href and href.startswith("/") else None
                    if url is None or _nav(url) or url in seen:
                        continue
                    seen.add(url)
                    heads = select_nodes(node, f.headline_sel) if f.headline_sel else []
                    text = " ".join((heads[0] if heads else node).text()).strip()
                    if len(text.encode()) < HEADLINE_BYTES[0]:
                        continue
                    text = text.encode()[: HEADLINE_BYTES[1]].decode("utf-8", "ignore")
                    image = ""
                    if f.image_sel and (found := select_nodes(node, f.image_sel)):
                        a = found[0].attrs
                        raw = next((a[k] for k in ("data-original", "data-src", "data-lazy-src", "src") if k in a), "")
                        if raw and "loader" not in raw and "placeholder" not in raw:
                            image = raw if raw.startswith("http") else "https:" + raw if raw.startswith("//") else f.base_url + raw if raw.startswith("/") else raw
                    rows.append((f.publisher_id, f.language, url, text, image, pos))
            yield pd.DataFrame(rows, columns=["publisher_id", "language", "url", "title", "image", "pos"])

    from ..functions.markup import is_good_image

    rows = files.mapInPandas(parse, "publisher_id string, language string, url string, title string, image string, pos int")
    return _raw(rows, F.col("url"), F.col("title"), F.lit(""), F.when(is_good_image(F.col("image")), F.col("image")), rfc3339(as_of))


def all_articles(*parts: DataFrame) -> DataFrame:
    """All sources in order, the first article of each URL."""
    out = None
    for rank, part in enumerate(parts):
        part = part.withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return keep_first(out, "original_url", "source_rank", "publisher_id", "pos").drop("source_rank")


def keep_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by a total order: a partial aggregate, so a key with very many rows is cut down before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    least = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return least.select(key, *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)]).select(*rows.columns)


def by_name(sources: DataFrame) -> DataFrame:
    """by_name: the name as a collated string, whose order is that of letters first, then accents, then case, as readers expect."""
    return sources.withColumn("by_name", F.collate(F.coalesce("name", F.lit("")), "UNICODE"))


def write_articles(rows: DataFrame, path: str, mode: str = "append") -> None:
    """The articles sink: Parquet, partitioned by category."""
    rows.write.mode(mode).partitionBy("category").parquet(path)


def image_of(html: Column) -> Column:
    return F.coalesce(extract_image(html), F.lit(""))
