"""Expressions over headlines and bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..constants import (
    ANCHOR_MIN_IDF, BOOST_HOURS, BOOST_MAX, COSINE_ANCHOR, COSINE_BASE, ENTITIES, LARGE_BUMP, NON_ARTICLE_PARTS, NON_ARTICLE_STARTS,
    SAME_PUBLISHER_BUMP, SMALL_CUT, SOURCE_SCORE, STALE_FACTOR, STALE_HOURS, STOP_WORDS,
)


def nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def is_non_article(headline: Column) -> Column:
    """Roundups, galleries, quizzes and the like."""
    low = F.lower(headline)
    hit = F.lit(False)
    for part in NON_ARTICLE_PARTS:
        hit = hit | low.contains(part)
    for start in NON_ARTICLE_STARTS:
        hit = hit | low.startswith(start)
    return hit


def within_bytes(text: Column, least: int, most: int | None = None) -> Column:
    """Length in bytes within bounds, both included."""
    n = F.octet_length(text)
    return (n >= least) & (n <= most) if most is not None else n >= least


def effective_headline(language: Column, headline: Column, translated: Column) -> Column:
    """English headlines as they are, others translated where a translation is there."""
    return F.when(language == "en", headline).otherwise(F.coalesce(F.nullif(translated, F.lit("")), headline))


def article_headline(wanted: Column, language: Column, headline: Column, translated: Column) -> Column:
    """The headline in the reader's language."""
    return F.when(wanted == language, headline).otherwise(F.coalesce(F.nullif(translated, F.lit("")), headline))


def cluster_text(headline: Column, snippet: Column, slug: Column) -> Column:
    """What articles are compared by: headline, snippet and slug words."""
    return F.concat_ws(" . ", headline, F.nullif(F.btrim(snippet), F.lit("")), F.nullif(slug, F.lit("")))


def entity_words(headline: Column) -> Column:
    """Capitalised words and numbers of a headline, as they stand."""

    def keep(w: Column) -> Column:
        core = F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        return (F.octet_length(core) >= 3) & (core.rlike(r"^\p{Lu}") | core.rlike(r"^[0-9.]+$"))

    return F.array_join(F.filter(F.split(headline, r"\s+"), keep), " ")


def normalize_numbers(text: Column) -> Column:
    """Thousands separators dropped; k and m after digits written out."""
    t = F.regexp_replace(text, r"([0-9]),+", "$1")
    t = F.regexp_replace(t, r"(?<=[0-9])[kK](?![\p{L}\p{N}])", "000")
    return F.regexp_replace(t, r"(?<=[0-9])[mM](?![\p{L}\p{N}])", "000000")


def tokens(headline: Column, stop_words: Sequence[str] = STOP_WORDS, entities: Sequence[str] = ENTITIES) -> Column:
    """array of (word, weight): 3 for numbers, 2 for acronyms, entities and names, 1 for others; then pairs of neighbours of weight 2 and more."""
    stops, names = list(stop_words), list(entities)

    def form(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.struct(w.alias("w"), low.alias("low"), F.octet_length(low).alias("n"), i.alias("i"))

    def kept(t: Column) -> Column:
        return ((t["n"] > 2) | ((t["n"] == 2) & t["w"].rlike(r"^\p{Lu}+$"))) & ~t["low"].isin(stops)

    def weigh(t: Column) -> Column:
        w, low = t["w"], t["low"]
        # Most words have no capital: of those, one without a letter may be a number, and no other is capitalised.
        small = F.when(low.rlike(r"\p{L}"), F.when(low.isin(names), 2).otherwise(1)).when(low.rlike("^[0-9]+$"), 3).when(F.octet_length(w) >= 2, 2).otherwise(1)
        capital = (F.octet_length(w) >= 2) & w.rlike(r"^[\p{Lu}\P{L}]+$")
        large = F.when(capital | low.isin(names) | ((t["i"] > 0) & w.rlike(r"^\p{Lu}")), 2).otherwise(1)
        return F.struct(low.alias("word"), F.when(w == low, small).otherwise(large).alias("weight"))

    single = F.transform(F.filter(F.transform(F.split(normalize_numbers(headline), r"[^\p{L}\p{N}]", -1), form), kept), weigh)
    # The pairs name the tokens four times; as a lambda's variable they are worked out once.
    return F.element_at(F.transform(F.array(single), with_pairs), 1)


def with_pairs(single: Column) -> Column:
    """Tokens followed by the joined pairs of neighbours that both weigh 2 or more."""
    shifted = F.slice(single, F.lit(2), F.greatest(F.size(single), F.lit(1)))
    zipped = F.filter(F.arrays_zip(single.alias("a"), shifted.alias("b")), lambda p: p["b"].isNotNull() & (p["a"]["weight"] >= 2) & (p["b"]["weight"] >= 2))
    return F.concat(single, F.transform(zipped, lambda p: F.struct(F.concat_ws("_", p["a"]["word"], p["b"]["word"]).alias("word"), F.lit(3).alias("weight"))))


def idf(n_stories: Column, with_word: Column) -> Column:
    """Inverse frequency of a word among stories."""
    return F.log((n_stories + 1) / (with_word + 1)) + 1


def is_anchor(weight: Column, word: Column, word_idf: Column) -> Column:
    """A shared word so specific that it lowers the threshold."""
    return (weight >= 2) & (F.octet_length(word) >= 3) & (F.coalesce(word_idf, F.lit(0.0)) >= ANCHOR_MIN_IDF)


def hours_between(a: Column, b: Column) -> Column:
    """Distance of two RFC 3339 texts in calendar hours of 730.5 a month; unreadable ones count as 0."""

    def hours(s: Column) -> Column:
        part = lambda at, n: F.substring(s, at, n).try_cast("double")
        return F.when(F.octet_length(s) >= 13, F.coalesce(part(1, 4) * 8766.0 + part(6, 2) * 730.5 + part(9, 2) * 24.0 + part(12, 2), F.lit(0.0))).otherwise(0.0)

    return F.abs(hours(a) - hours(b))


def time_boost(hours: Column) -> Column:
    """Reward for stories updated near the article's time."""
    return F.lit(1.0) + BOOST_MAX * F.exp(-hours / BOOST_HOURS)


def threshold(hours: Column, anchor: Column, size: Column, same_publisher: Column) -> Column:
    """The score that an article needs to join a story."""
    base = F.when(hours > STALE_HOURS, COSINE_BASE * STALE_FACTOR).when(anchor, COSINE_ANCHOR).otherwise(COSINE_BASE)
    by_size = F.when(size >= 5, LARGE_BUMP).when(size <= 2, -SMALL_CUT).otherwise(0.0)
    return base + by_size + F.when(same_publisher, SAME_PUBLISHER_BUMP).otherwise(0.0)


def source_score(category: Column) -> Column:
    """How good a source's headlines are; unknown sources 1."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SOURCE_SCORE.items() for x in pair]), category), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def read_minutes(text: Column) -> Column:
    """Minutes to read an article, at least one."""
    return F.greatest(F.lit(1), F.floor(word_count(text) / 200 + 0.5).cast("int"))


def card_minutes(summary: Column, snippet: Column) -> Column:
    """Minutes shown on a story's card; 0 without text."""
    text = nonempty(summary, snippet)
    factor = F.when(F.nullif(summary, F.lit("")).isNotNull(), 10).otherwise(17)
    return F.when(text.isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(word_count(text) * factor / 200 + 0.5).cast("int")))


def card_snippet(summary: Column, snippet: Column, body: Column, most: int = 140) -> Column:
    """The summary, else the start of the snippet, else of the body's first paragraph."""
    return F.coalesce(F.nullif(summary, F.lit("")), F.left(F.nullif(snippet, F.lit("")), F.lit(most)), F.left(F.split_part(F.nullif(body, F.lit("")), F.lit("\n\n"), F.lit(1)), F.lit(most)))


def clean_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def summary_context(headlines: Column, snippets: Column) -> Column:
    """What a summariser is given: five headlines and two snippets, 700 characters."""
    return F.left(F.concat_ws(" ", F.array_join(F.slice(headlines, 1, 5), ". "), F.array_join(F.slice(F.filter(snippets, lambda s: s != ""), 1, 2), " ")), F.lit(700))


def combined_summary(bodies: Column) -> Column:
    """Up to five sentences of the bodies' first two paragraphs that overlap no earlier one by more than half of the smaller's words."""
    texts = F.filter(bodies, lambda b: b.isNotNull() & (b != ""))
    lead = lambda t: F.array_join(F.slice(F.split(t, "\n\n"), 1, 2), " ")
    sentences = F.flatten(F.transform(texts, lambda t: F.filter(F.transform(F.split(lead(t), r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: F.length(s) > 25)))
    words = lambda s: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(s), r"[^a-z\s]", ""), r"\s+"), lambda w: F.length(w) > 3))
    rows = F.filter(F.transform(sentences, lambda s: F.struct(s.alias("s"), words(s).alias("w"))), lambda r: F.size(r["w"]) >= 2)
    none = F.array().cast("array<struct<s:string,w:array<string>>>")

    def step(picked: Column, r: Column) -> Column:
        again = F.exists(picked, lambda p: F.size(F.array_intersect(r["w"], p["w"])) / F.least(F.size(r["w"]), F.size(p["w"])) > 0.5)
        return F.when((F.size(picked) >= 5) | again, picked).otherwise(F.concat(picked, F.array(r)))

    many = F.left(F.array_join(F.transform(F.aggregate(rows, none, step), lambda p: p["s"]), " "), F.lit(500))
    return F.when(F.size(texts) == 0, "").when(F.size(texts) == 1, F.left(lead(F.element_at(texts, 1)), F.lit(400))).otherwise(many)


def shuffle_score(story_id: Column, key: int, n_articles: Column) -> Column:
    """A reproducible shuffle: a 32-bit rolling hash of the id mixed with the story's size."""
    codes = F.transform(F.filter(F.split(story_id, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(key).cast("long"), lambda acc, c: F.pmod(acc * 31 + c, F.lit(4294967296)))
    return F.log(1 + n_articles.cast("double")) + F.pmod(h, F.lit(1000)) / 1000 * 2
