"""Personal data in texts by weak supervision; DataFrame functions only.

1. Base spans: one pattern and one test for each kind (e-mail addresses, IP addresses, card and telephone numbers), leftmost matches
   without overlaps, failing matches dropped without retries.  They are always part of the result.
2. Candidates: a wider pattern for each kind finds numbers inside longer runs, other groupings, obfuscated addresses, decoys too.
3. Labelers vote for, against or abstain on every candidate: format (regular expressions, checksums), gazetteer (top-level domains,
   issuers, networks, calling codes), cue words before it, the characters around it, its own monotony.
4. Expectation-maximisation estimates each kind's share of true candidates and each labeler's votes on true and on false ones, from
   the counts of vote patterns: at most 3^5 of a kind, whatever the corpus.  A step is one aggregation of that table.
5. The span classifier, a naive Bayes model over features of the span and its surroundings (no votes), learns from the estimated
   labels in one aggregation.  Every feature has a bounded set of values, so has the model.
6. A candidate of probability 0.5 or more joins the result if it overlaps no base span of its kind.

Patterns are written so that neither time nor stack grows with the square or depth of a match: repeated groups are single classes
bounded by a look ahead, starts inside a run are refused.  Spans of a document are found and judged within its own row: texts
are neither shuffled nor joined, a document's spans travel with its row.

Rows: null text is empty and has no spans; rows that repeat an id, or have none, are documents of their own.  Texts without candidates, or a
corpus without any, leave the base spans.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .shared_store import Store

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: Leftmost matches of [local]+@label(.label)+ : a match starts where a run of local characters starts, or the match before ends.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++\.{_LABEL}[A-Za-z0-9.-]*?(?=\.?(?![A-Za-z0-9.-])|\.\.)"
#: Leftmost matches of four numbers with dots between.
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Leftmost matches of digits with single spaces or hyphens between, of 16 digits at least.
CARD = r"[0-9](?=(?:[\x20-]?[0-9]){15})[0-9\x20-]*?[0-9](?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

_AT, _DOT = r"\x20?[(\[{][aA][tT][)\]}]\x20?", r"\x20?[(\[{][dD][oO][tT][)\]}]\x20?"
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:@|{_AT}){_LABEL}{{1,63}}+(?:(?:\.|{_DOT}){_LABEL}{{1,63}}+){{1,8}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.[0-9]{1,3}){3}|(?:\[\.\][0-9]{1,3}){3})(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without a match of this has no match of the kind's patterns.
NEEDED = {"email": r"@|[(\[{][aA][tT][)\]}]", "ip": r"[0-9](?:\.|\[\.\])[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}", "phone": r"\+[0-9]|[0-9)][\x20.-]?[0-9]{3,4}[\x20.-][0-9]"}

#: Gazetteers, fixed values: domains and networks that people and machines have, issuers' first digits, calling codes.
DOMAINS = r"(?i)[.)\]}]\x20?(?:com|org|net|edu|gov|mil|int|info|biz|name|io|ai|app|dev|co|eu|uk|us|de|fr|es|it|mt|nl|be|ch|at|pl|pt|se|no|dk|fi|ie|ca|au|nz|in|jp|cn|br|mx|ru|za)$"
NETWORKS = r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|\[\.\])|:"
SMALL_PARTS = r"^[0-9](?:(?:\.|\[\.\])[0-9]){3}$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|62|50|5[6-8])"
CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|[56789][0-9]{2})(?![0-9])"
#: Words before a span that speak for its kind, and those that speak against any.
CUES = {
    "email": "e-?mail|mail|contact|write|address|reach|kontakt|correo|courriel",
    "ip": "ip|ipv4|ipv6|host|server|address|addr|client|login|adresse|servidor",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|teléfono|téléphone",
}
AGAINST = "version|ver|v|release|section|chapter|isbn|issn|id|order|invoice|sku|serial|token|hash|sha|doi|build"

LABELERS = ["format", "gazetteer", "cue", "around", "monotony"]
_STEPS = 15


def _spans(text: Column, pattern: str, needed: str) -> Column:
    """Arrays side by side: the matches, and for every gap around them its length, its last 32 and its first 8 code points."""
    has = text.rlike(needed)
    hits = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.char_length(p).alias("n"), F.substring(p, -32, 32).alias("last"), F.substring(p, 1, 8).alias("first")))
    return F.struct(hits.alias("hits"), F.when(has, gaps).alias("gaps"))


def _placed(found: str) -> Column:
    """array of start, end, value, before, after of each match, in order."""
    steps = F.arrays_zip(F.col(f"{found}.hits").alias("value"), F.slice(f"{found}.gaps", 1, F.size(f"{found}.hits")).alias("gap"), F.slice(f"{found}.gaps", 2, F.size(f"{found}.hits")).alias("next"))
    kind = "array<struct<start: int, end: int, value: string, before: string, after: string>>"

    def add(done: Column, s: Column) -> Column:
        start = done["at"] + s["gap"]["n"]
        end = start + F.char_length(s["value"])
        one = F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value"), s["gap"]["last"].alias("before"), s["next"]["first"].alias("after"))
        return F.struct(end.alias("at"), F.array_append(done["all"], one).alias("all"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("all"))
    return F.when(F.size(f"{found}.hits") > 0, F.aggregate(steps, empty, add, lambda done: done["all"])).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, each second one from the right doubled, divisible by 10."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _octets(value: Column) -> Column:
    """All numbers at most 255."""
    return ~F.exists(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{4,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])$"))


def _holds(kind: str, value: Column) -> Column:
    """The test of a base match."""
    digits = F.char_length(_digits(value))
    return {"email": F.lit(True), "ip": _octets(value), "card": digits.between(16, 19) & _luhn(_digits(value)), "phone": digits.between(8, 15)}[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _glued(s: Column) -> Column:
    """A letter, digit, quote or joining sign touches the span: part of a token, not a thing of its own."""
    return s["before"].rlike(r"[\p{L}\p{N}_:/=\"'#-]$") | s["after"].rlike(r"^(?:[\p{L}\p{N}_:/=\"'@-]|\.[0-9])")


def _votes(kind: str, s: Column) -> Column:
    """array of the labelers' votes, in their order."""
    v = s["value"]
    digits = _digits(v)
    wide = v.contains(":")
    form = {
        "email": _vote(v.rlike(rf"^{_LOCAL}++@{_LABEL}++\."), F.lit(False)),
        "ip": F.when(wide, 1).otherwise(_vote(_octets(v), ~_octets(v))),
        "card": _vote(_luhn(digits), ~_luhn(digits)),
        "phone": _vote(v.rlike(r"^\+"), F.lit(False)),
    }[kind]
    known = {
        "email": _vote(v.rlike(DOMAINS), ~v.rlike(DOMAINS)),
        "ip": _vote(v.rlike(NETWORKS) & ~v.rlike(SMALL_PARTS), v.rlike(SMALL_PARTS)),
        "card": _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": _vote(v.rlike(CODES), v.rlike(r"^\+")),
    }[kind]
    cue = _vote(s["before"].rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{CUES[kind]})[^\p{{L}}\p{{N}}]{{1,8}}$"), s["before"].rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{AGAINST})[^\p{{L}}\p{{N}}]{{0,8}}$"))
    around = _vote(~_glued(s), _glued(s))
    monotony = _vote(F.lit(False), digits.rlike(r"^([0-9])\1{5,}$|^0123456789|^1234567890"))
    return F.array(form, known, cue, around, monotony)


def _edge(text: Column, pattern: str) -> Column:
    c = F.regexp_extract(text, pattern, 0)
    return F.when(c == "", "none").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\p{N}"), "digit").when(c.rlike(r"\s"), "space").otherwise("sign")


def _features(kind: str, s: Column) -> Column:
    """array of strings name=value; every name has a bounded set of values."""
    v = s["value"]
    digits = _digits(v)
    check = {"email": v.rlike(DOMAINS), "ip": v.contains(":") | _octets(v), "card": _luhn(digits), "phone": v.rlike(CODES)}[kind]
    start = {"email": _edge(v, "^."), "ip": F.char_length(F.regexp_extract(v, "^[0-9]*", 0)).cast("string"), "card": F.substring(digits, 1, 1), "phone": F.regexp_extract(v, r"^[+(]?", 0)}[kind]
    form = F.regexp_replace(F.regexp_replace(v, r"[\p{L}\p{N}]+", ""), r"(.)\1*", "$1")
    named = {
        "before": _edge(s["before"], r".$"),
        "after": _edge(s["after"], r"^."),
        "check": check.cast("string"),
        "start": start,
        "signs": F.when(F.char_length(form) <= 3, form).otherwise("many"),
        "digits": F.least(F.char_length(digits), F.lit(20)).cast("string"),
    }
    return F.array(*[F.concat(F.lit(f"{n}="), x) for n, x in named.items()])


def _bounds(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"))


def find(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; for each kind base_<kind> (array of start, end) and wide_<kind> (array of start, end, votes, features), written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(id_col).alias("doc_id"), *[_spans(text, p[k], NEEDED[k]).alias(f"{n}_{k}") for n, p in (("base", BASE), ("wide", WIDE)) for k in KINDS])
    raw = raw.select("doc_id", *[_placed(f"{n}_{k}").alias(f"{n}_{k}") for n in ("base", "wide") for k in KINDS])

    def kept(kind: str) -> Column:
        return F.transform(F.filter(f"base_{kind}", lambda s: _holds(kind, s["value"])), _bounds).alias(f"base_{kind}")

    def judged(kind: str) -> Column:
        return F.transform(f"wide_{kind}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _votes(kind, s).alias("votes"), _features(kind, s).alias("features"))).alias(f"wide_{kind}")

    base, wide = [kept(k) for k in KINDS], [judged(k) for k in KINDS]
    return store.write(raw.select("doc_id", *base, *wide), "found")


def _by_key(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))])


def _log_odds(prior: dict[str, float], terms: dict[str, float], kind: Column, keys: Column) -> Column:
    """The kind's prior and the terms of its keys, added up; a key that was never seen adds nothing."""
    if not prior:
        return F.lit(-1e9)
    table, start = _by_key(terms), F.coalesce(F.element_at(_by_key(prior), kind), F.lit(-1e9))
    return F.aggregate(keys, start, lambda total, key: total + F.coalesce(F.element_at(table, F.concat(kind, F.lit("|"), key)), F.lit(0.0)))


def _probability(odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _fitted(sums: list, start_kind: float = 1.0) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of kinds and of keys from rows (kind, name, value, yes, no): sums of probabilities, with a little added to each value."""
    names: dict[tuple, list] = {}
    for r in sums:
        names.setdefault((r["kind"], r["name"]), []).append(r)
    prior, terms = {}, {}
    for (kind, name), rows in sorted(names.items()):
        yes, no, v = sum(r["yes"] for r in rows), sum(r["no"] for r in rows), len(rows)
        prior[kind] = math.log((yes + start_kind) / (no + start_kind))
        for r in rows:
            terms[f"{kind}|{name}={r['value']}"] = math.log((r["yes"] + 0.5) / (yes + 0.5 * v)) - math.log((r["no"] + 0.5) / (no + 0.5 * v))
    return prior, terms


def _keys() -> Column:
    """The votes as keys name=vote."""
    return F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in LABELERS]).alias("name"), F.col("votes").alias("vote")), lambda x: F.concat(x["name"], F.lit("="), x["vote"].cast("string")))


def _sums(rows: DataFrame, weight: Column, odds: Column, keys: Column) -> list:
    """Expected counts by kind and key: a bounded number of rows."""
    p = _probability(odds)
    each = rows.select("kind", weight.alias("n"), p.alias("p"), F.explode(keys).alias("key"))
    name, value = F.substring_index("key", "=", 1), F.expr("substr(key, locate('=', key) + 1)")
    return each.groupBy("kind", name.alias("name"), value.alias("value")).agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()


def candidates(found: DataFrame) -> DataFrame:
    """kind, votes, features of every candidate."""
    parts = [found.select(F.lit(k).alias("kind"), F.explode(f"wide_{k}").alias("s")).select("kind", "s.votes", "s.features") for k in KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def estimate(found: DataFrame, store: Store) -> tuple[dict[str, float], dict[str, float]]:
    """Reliabilities: log-odds of each kind and of each labeler's votes, by expectation-maximisation from the majority of votes, formats counting twice."""
    patterns = store.write(candidates(found).groupBy("kind", "votes").agg(F.count("*").alias("n")).withColumn("keys", _keys()), "patterns")
    votes = F.aggregate("votes", F.element_at("votes", 1), lambda total, v: total + v)  # the first labeler is the format
    odds = (votes - F.lit(0.5)).cast("double")
    prior: dict[str, float] = {}
    terms: dict[str, float] = {}
    for _ in range(_STEPS):
        old = terms
        prior, terms = _fitted(_sums(patterns, F.col("n"), odds, F.col("keys")))
        if terms.keys() == old.keys() and all(abs(terms[k] - old[k]) < 1e-4 for k in terms):
            break
        odds = _log_odds(prior, terms, F.col("kind"), F.col("keys"))
    return prior, terms


def classifier(found: DataFrame, prior: dict[str, float], terms: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """The span classifier: log-odds of each kind and of each feature, learnt from the estimated labels."""
    return _fitted(_sums(candidates(found), F.lit(1), _log_odds(prior, terms, F.col("kind"), _keys()), F.col("features")))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; base_<kind> and added_<kind> for each kind: arrays of (start, end), in order."""
    store = Store(docs.sparkSession, "personal-data")
    found = find(docs, store, id_col, text_col)
    prior, terms = classifier(found, *estimate(found, store))
    store.keep_only(found)

    def added(kind: str) -> Column:
        likely = F.filter(f"wide_{kind}", lambda s: _probability(_log_odds(prior, terms, F.lit(kind), s["features"])) >= 0.5)
        free = F.filter(likely, lambda s: ~F.exists(f"base_{kind}", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.transform(free, _bounds)

    return found.select("doc_id", *[f"base_{k}" for k in KINDS], *[added(k).alias(f"added_{k}") for k in KINDS])


def listed(*arrays: Column) -> Column:
    """kind:start:end, by kind in their order, then by start, comma-joined; one array of (start, end) for each kind."""

    def named(kind: str, spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(k, a) for k, a in zip(KINDS, arrays)]), ",")
