"""URL expressions: identity, parts, and what a URL says about its page."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..constants import HEADLINE_CATEGORIES, NAV_ENDS, NAV_PARTS, NAV_SLASHES, URL_CATEGORIES


def count_of(text: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def canonical_url(url: Column) -> Column:
    """Without fragment; without trailing slashes if there are more than three slashes; then without query."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    bare = F.when(bare.endswith("/") & (count_of(bare, "/") > 3), F.rtrim(bare, F.lit("/"))).otherwise(bare)
    return F.split_part(bare, F.lit("?"), F.lit(1))


def stable_id(url: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the canonical URL."""
    return F.substring(F.sha2(canonical_url(url), 256), 1, 16)


def domain(url: Column) -> Column:
    """The host of a URL."""
    return F.split_part(F.regexp_replace(url, "^https?://", ""), F.lit("/"), F.lit(1))


def favicon(url: Column) -> Column:
    """The favicon address of a URL's site; empty where there is no host."""
    site = F.regexp_extract(url, r"^((?:.*?://)?[^/]*)", 1)
    return F.when(F.regexp_extract(url, r"^(?:.*?://)?([^/]*)", 1) == "", F.lit("")).otherwise(F.concat(site, F.lit("/favicon.ico")))


def absolute_url(text: Column) -> Column:
    """A typed address with its scheme."""
    return F.when(text.startswith("http://") | text.startswith("https://"), text).when(text.startswith("//"), F.concat(F.lit("https:"), text)).otherwise(F.concat(F.lit("https://"), F.ltrim(text, F.lit("/"))))


def origin(url: Column) -> Column:
    """Scheme and host."""
    return F.rtrim(F.array_join(F.slice(F.split(url, "/"), 1, 3), "/"), F.lit("/"))


def slug_words(url: Column) -> Column:
    """Words of the last path segment, if it has two or more of over three bytes that are no numbers."""
    path = F.regexp_replace(url, r"^(?:.*?://)?[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.split_part(F.coalesce(F.get(F.slice(parts, -1, 1), F.lit(0)), F.lit("")), F.lit("."), F.lit(1))
    last = F.when(F.size(parts) == 0, F.lit("")).otherwise(last)
    words = F.filter(F.split(last, "[-_]"), lambda w: (F.octet_length(w) > 3) & ~w.rlike("^[0-9]+$"))
    return F.when(F.size(words) >= 2, F.array_join(words, " ")).otherwise(F.lit(""))


def is_nav_link(url: Column) -> Column:
    """The URL leads to a section or service page, not to an article."""
    low = F.lower(url)
    hit = low.endswith("/") & (count_of(low, "/") <= NAV_SLASHES)
    for end in NAV_ENDS:
        hit = hit | low.endswith(end)
    for part in NAV_PARTS:
        hit = hit | low.contains(part)
    return hit


def classify(url: Column, headline: Column) -> Column:
    """The category that the URL gives, else the headline, else ``general``.

    One pattern for each category, so a text is lower-cased and read a few times, not once for each word.
    """
    out = None
    for text, rules in ((url, URL_CATEGORIES), (headline, HEADLINE_CATEGORIES)):
        low = F.lower(F.coalesce(text, F.lit("")))
        for name, parts in rules:
            hit = low.rlike("|".join(map(re.escape, parts)))
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("general"))
