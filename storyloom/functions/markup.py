"""Expressions over HTML and XML text, and the few that need a parser."""

from __future__ import annotations

from functools import lru_cache
from html.parser import HTMLParser
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..constants import ARTICLE_LINKS, BAD_IMAGE_ENDS, BAD_IMAGE_PARTS, BODY_CONTAINERS, HTML_ENTITIES, IMAGE_ATTRIBUTES, NAV_ENDS, NAV_PARTS, NAV_SLASHES, SNIPPET_BYTES


def strip_html(html: Column) -> Column:
    """Text outside tags with white space collapsed; an unclosed tag runs to the end."""
    text = F.replace(F.regexp_replace(html, r"<[^>]*>?", ""), F.lit(">"), F.lit(""))
    return F.btrim(F.regexp_replace(text, r"[\s\u0085   -     　]+", " "))


def once(value: Column, f) -> Column:
    """f(value), with the value worked out once although f reads it several times, also within lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def byte_prefix(text: Column, most: int) -> Column:
    """The longest prefix of whole characters that has at most so many bytes."""

    def cut(t: Column) -> Column:
        fits = F.array_max(F.filter(F.sequence(F.lit(most // 4), F.lit(most)), lambda n: F.octet_length(F.left(t, n)) <= most))
        return F.when(F.octet_length(t) > most, F.left(t, fits)).otherwise(t)

    return once(text, cut)


def snippet(summary: Column) -> Column:
    """A feed summary without tags and the boilerplate from "The post " on, at most 500 bytes."""
    lead = once(strip_html(summary), lambda t: F.when(t.contains("The post "), F.btrim(F.split_part(t, F.lit("The post "), F.lit(1)))).otherwise(t))
    return byte_prefix(lead, SNIPPET_BYTES)


def is_good_image(url: Column) -> Column:
    """The URL may be a picture of the story."""
    low = F.lower(url)
    bad = F.lit(False)
    for part in BAD_IMAGE_PARTS:
        bad = bad | low.contains(part)
    for end in BAD_IMAGE_ENDS:
        bad = bad | low.endswith(end)
    return ~bad


def resolve_image(raw: Column) -> Column:
    """An absolute image URL, or null."""
    t = F.btrim(raw)
    return F.when((t == "") | t.startswith("data:"), F.lit(None).cast("string")).when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.startswith("http"), t)


def _good(raw: Column) -> Column:
    url = resolve_image(raw)
    return F.when(is_good_image(url), url)


def extract_image(html: Column) -> Column:
    """The first good image of the ``<img `` tags: by attribute order, then the last candidate of a srcset; null if none."""

    def of_tag(tag: Column) -> Column:
        tries = []
        for attr in IMAGE_ATTRIBUTES:
            quote = attr[-1]
            found = F.regexp_extract(tag, f"(?is){re.escape(attr)}([^{quote}]*){quote}", 1)
            tries.append(F.when(found != "", _good(found)))
        for quote in "\"'":
            listed = F.regexp_extract(tag, f"(?is)srcset={quote}([^{quote}]*){quote}", 1)
            last = F.btrim(F.element_at(F.split(listed, ","), -1))
            tries.append(F.when(listed != "", _good(F.element_at(F.split(last, r"\s+"), 1))))
        return F.coalesce(*tries)

    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<img [^>]*>?)"), F.lit(1))
    return F.get(F.filter(F.transform(tags, of_tag), lambda u: u.isNotNull()), F.lit(0))


def meta_content(tag: Column) -> Column:
    """The content attribute of a meta tag: quoted, else up to white space; null if none."""
    tries = [F.when(tag.rlike(f"(?i)content={q}[^{q}]*{q}"), F.regexp_extract(tag, f"(?i)content={q}([^{q}]*){q}", 1)) for q in "\"'"]
    bare = F.regexp_extract(tag, r"""(?i)content=([^\s>"']+)""", 1)
    return F.coalesce(*tries, F.when(bare != "", bare))


def meta_image(html: Column) -> Column:
    """og:image (not its sub-properties), else twitter:image; null if none is good."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"(<(?:meta|META)[^>]*>)"), F.lit(1)), lambda t: F.translate(t, "\n\r\t", "   "))

    def first(keep) -> Column:
        urls = F.transform(F.filter(tags, lambda t: keep(F.lower(t))), meta_content)
        return F.get(F.filter(urls, lambda u: u.startswith("http") & is_good_image(u)), F.lit(0))

    return F.coalesce(first(lambda t: t.contains("og:image") & ~t.contains("og:image:")), first(lambda t: t.contains("twitter:image")))


def feed_image(content: Column, media: Column, enclosure: Column, summary: Column) -> Column:
    """The image of a feed entry by source order; empty if none."""
    return F.coalesce(extract_image(content), meta_image(content), _good(media), _good(enclosure), extract_image(summary), F.lit(""))


def xml_tag(xml: Column, tag: str) -> Column:
    """Text of the first element whose name starts with ``tag``, CDATA unwrapped; null if empty or absent."""
    text = F.btrim(F.regexp_extract(xml, f"(?s)<{re.escape(tag)}[^>]*>(.*?)</{re.escape(tag)}>", 1))
    text = F.regexp_replace(text, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")
    return F.when(text != "", text)


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of a tag; null if absent or not quoted."""
    return F.coalesce(*[F.when(tag.rlike(f"(?is)^.*?{name}={q}[^{q}]*{q}"), F.regexp_extract(tag, f"(?is){name}={q}([^{q}]*){q}", 1)) for q in "\"'"])


def page_title(html: Column) -> Column:
    """The text of the title element; null if there is none."""
    return F.when(html.rlike(r"(?is)<title>.*?</title>"), F.btrim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)))


def feed_link(html: Column, base: Column) -> Column:
    """The first alternate RSS or Atom link, made absolute; null if none."""
    from .urls import origin

    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link[^>]*>?)"), F.lit(1))
    fits = F.filter(tags, lambda t: F.lower(t).rlike(r"application/(rss|atom)\+xml") & F.lower(t).contains("alternate"))
    href = F.get(F.filter(F.transform(fits, lambda t: attribute(t, "href")), lambda h: h.isNotNull()), F.lit(0))
    return F.when(href.rlike("^https?://"), href).when(href.isNotNull(), F.concat(origin(base), F.lit("/"), F.ltrim(href, F.lit("/"))))


def decode_entities(text: Column) -> Column:
    """The fixed entities decoded in one pass; others stay."""
    # Each entity is looked up once, so nothing is decoded twice; an ampersand without a semicolon after it is text.
    pieces = F.regexp_extract_all(text, F.lit("&[^;]+;|[^&]+|&"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in HTML_ENTITIES.items() for x in pair])
    return F.when(text.contains("&") & text.contains(";"), F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")).otherwise(text)


class _Node:
    __slots__ = ("tag", "attrs", "children", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: "_Node | None"):
        self.tag, self.attrs, self.children, self.up = tag, attrs, [], up

    def text(self) -> list[str]:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo.extend(reversed(n.children))
        return out

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            if not isinstance(n, str):
                yield n
                todo.extend(reversed(n.children))


class _Tree(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.up
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.children.append(data)


def parse_html(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


_STEP = re.compile(r"^([a-zA-Z0-9*]*)((?:\.[\w-]+|\[[^\]]+\])*)$")


def _fits(node: _Node, step: str) -> bool:
    m = _STEP.match(step)
    if not m or m[1] not in ("", "*", node.tag):
        return False
    for part in re.findall(r"\.[\w-]+|\[[^\]]+\]", m[2]):
        if part[0] == ".":
            if part[1:] not in node.attrs.get("class", "").split():
                return False
        else:
            name, op, value = re.match(r"\[([\w-]+)(?:([*^$]?=)[\"']?(.*?)[\"']?)?\]", part).groups()
            have = node.attrs.get(name)
            if have is None or op == "=" and have != value or op == "*=" and value not in have or op == "^=" and not have.startswith(value) or op == "$=" and not have.endswith(value):
                return False
    return True


def select_nodes(root: _Node, selector: str) -> list[_Node]:
    """Nodes in document order that fit a selector of tags, classes, attributes and descendants; commas give alternatives."""
    plans = [s.split() for s in selector.split(",")]

    def fits(node, steps):
        if not _fits(node, steps[-1]):
            return False
        k, n = len(steps) - 2, node.up
        while k >= 0 and n is not None:
            if _fits(n, steps[k]):
                k -= 1
            n = n.up
        return k < 0

    return [n for n in root.walk() if n is not root and any(fits(n, s) for s in plans)]


def body_of(html: str) -> str:
    """Paragraphs of the first container that has two of over 30 bytes, else all of over 40 bytes if there are two."""
    root = parse_html(html)
    paragraphs = lambda n, least: [t for t in (" ".join(p.text()).strip() for p in select_nodes(n, "p")) if len(t.encode()) > least]
    for selector in BODY_CONTAINERS:
        found = select_nodes(root, selector)
        if found and len(got := paragraphs(found[0], 30)) >= 2:
            return "\n\n".join(got)
    got = paragraphs(root, 40)
    return "\n\n".join(got) if len(got) >= 2 else ""


def _nav(url: str) -> bool:
    low = url.lower()
    return low.endswith(tuple(NAV_ENDS)) or any(p in low for p in NAV_PARTS) or low.endswith("/") and low.count("/") <= NAV_SLASHES


#: The containers of ``ARTICLE_LINKS``: each pattern is one, told by tag and class, around a link.
_AROUND = [s.removesuffix(" a[href]") for s in ARTICLE_LINKS]


@lru_cache(maxsize=4096)
def _containers(tag: str, classes: str | None) -> int:
    """A bit for each of ``_AROUND`` that an element of this tag and class is."""
    node = _Node(tag, {} if classes is None else {"class": classes}, None)
    return sum(1 << k for k, step in enumerate(_AROUND) if _fits(node, step))


def best_link_pattern(html: str) -> str | None:
    """The link pattern with the most article links (two at least); the earlier one on a tie.  One walk, which carries the containers around a node."""
    counts = [0] * len(ARTICLE_LINKS)
    todo = [(n, 0) for n in parse_html(html).children]
    while todo:
        node, around = todo.pop()
        if isinstance(node, str):
            continue
        if around and node.tag == "a" and (href := node.attrs.get("href")) and not _nav(href) and len(" ".join(node.text()).strip().encode()) >= 10:
            for k in range(len(counts)):
                counts[k] += around >> k & 1
        around |= _containers(node.tag, node.attrs.get("class"))
        todo.extend((n, around) for n in node.children)
    most = max(counts)
    return ARTICLE_LINKS[counts.index(most)] if most > 1 else None


@F.pandas_udf(StringType())
def body_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: body_of(x) if x else "")


@F.pandas_udf(StringType())
def article_link_pattern(html: pd.Series) -> pd.Series:
    return html.map(lambda x: best_link_pattern(x) if x else None)
