"""The pattern of links against one search for each pattern, and how often elements are tested."""

import random

from storyloom.constants import ARTICLE_LINKS
from storyloom.functions import markup as M


def _plain(html):
    root = M.parse_html(html)
    best, most = None, 1
    for selector in ARTICLE_LINKS:
        n = sum(1 for a in M.select_nodes(root, selector) if a.attrs.get("href") and not M._nav(a.attrs["href"]) and len(" ".join(a.text()).strip().encode()) >= 10)
        if n > most:
            best, most = selector, n
    return best


def _page(rng, depth=4):
    if depth == 0 or rng.random() < 0.1:
        return "some text"
    tag = rng.choice(["article", "h1", "h2", "h3", "div", "p", "a", "a", "A", "span", "br"])
    kind = rng.choice(["", "", " class", " class=''", " class='entry-title x'", " class='my-headline'", " class='post-title'", " class=\"Title\"", " class='subtitle'"])
    href = rng.choice(["", " href='/a/long.html'", " href='/tag/x'", " href=''", " href='/a/b/c/d/'"]) if tag in "aA" else ""
    inner = "".join(_page(rng, depth - 1) for _ in range(rng.randrange(5)))
    return f"<{tag}{kind}{href}>{inner}" + ("" if rng.random() < 0.1 else f"</{tag}>")


def test_one_walk(monkeypatch):
    rng, found = random.Random(5), set()
    for _ in range(400):
        html = "".join(_page(rng) for _ in range(6))
        found.add(M.best_link_pattern(html))
        assert M.best_link_pattern(html) == _plain(html)
    assert len(found) > 4
    calls, fits = [], M._fits
    monkeypatch.setattr(M, "_fits", lambda *a: calls.append(a) or fits(*a))
    assert M.best_link_pattern("".join(f"<h3><a href='/s/{k}.html'>Headline that is long</a></h3>" for k in range(500))) == "h3 a[href]"
    assert len(calls) <= 50
