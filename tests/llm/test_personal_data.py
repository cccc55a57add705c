"""Base spans against plain patterns; added spans against a plain version of the voting, its estimation and the classifier."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from storyloom.llm import personal_data as P
from storyloom.llm.shared_store import Store
from storyloom.llm import queries

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def results(spark, texts):
    rows = P.personal_data(table(spark, texts)).collect()
    return {r.doc_id: {k: ([tuple(s) for s in r[f"base_{k}"]], [tuple(s) for s in r[f"added_{k}"]]) for k in P.KINDS} for r in rows}


ODD = [
    None, "", "no data here", "a@b.c_x@y.org", "a@b.com.", "a@b..com x@y.z", "a@b.c@d.e", "..x@y.z..w@v.u", "@b.c", "a@.b", "a@b.c-", "é@b.co ü.v@b.co 😀 q@r.st",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "001.002.003.0004", "1.2.3", "1..2.3.4.5", "999999999999.1.1.1 00000000000001.1.1.1",
    "4111111111111111", "4111 1111 1111 1111", "4111-1111 1111-1111", "4111  1111 1111 1111", "4111111111111111 27.109.211.155", "41111111111111112222", "7536784127813050 4845168114407329",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "4111111111111111-", "-4111111111111111 x", "+1 (826) 555-4081", "+1 (826) 555-4081 190.137.223.204", "+1 (578) 555-6437 4918187128635271", "+12345678", "+1 2", "++1 (826) 555-4081)(", "+1 (2) 3 4 5 6 7 8 9 .",
    "a\nb@c.de\n1.2.3.4\n", "x" * 3000 + "@y.org", "1" * 5000, "1 " * 4000, "a@" + "b." * 4000 + "c", "a." * 5000, "+1" * 3000, "1.1.1.1." * 500, "+1" + " " * 20000,
]


def test_base_spans(spark):
    """Odd texts, and random ones."""
    rng = random.Random(5)
    bits = ["a", "B9", "@", ".", "-", " ", "_", "é", "1", "22", "255", "4111", "1111", "+1", "(", ")", "\n", "c.de", "@x.yz", "0"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(80))) for _ in range(3000)]
    got = results(spark, texts)
    for k, text in enumerate(texts):
        assert [(kind, *s) for kind in P.KINDS for s in got[k][kind][0]] == base_spans(text), text


def test_spans_that_base_patterns_miss(spark):
    """Numbers run together, another grouping, a hidden address; decoys stay out."""
    filler = [f"mail me at user{k}@example{k % 7}.com or call +1 ({200 + k}) 555-0{k % 1000:03d} today" for k in range(40)]
    cards = [f"card {n} paid" for n in ("4111111111111111", "4845168114407329", "5500005555555559", "4012888888881881") for _ in range(5)]
    decoys = ["number 9807915762804490 here", "of 7086638319846192 the", "with 4661596371091201 parts"] * 6
    missed = ["see 7536784127813050 4845168114407329 there", "4918187128635271 27.109.211.155 x", "call +1 (578) 555-6437 4918187128635271 now"]
    texts = filler + cards + decoys + missed
    got = results(spark, texts)
    at = len(texts) - 3
    assert got[at]["card"] == ([], [(21, 37)]) and got[at + 1]["card"] == ([], [(0, 16)])
    assert got[at + 2]["phone"] == ([], [(5, 22)]) and got[at + 2]["card"] == ([], [(23, 39)])
    for k in range(len(filler) + len(cards), at):
        assert not any(base or added for base, added in got[k].values())


def plain(rows):
    """rows: (kind, votes, features) of every candidate -> the classifier's log-odds, by loops over them."""

    def fit(weighted):
        sums = defaultdict(lambda: [0.0, 0.0])
        for kind, keys, p in weighted:
            for name, value in keys:
                sums[kind, name, value][0] += p
                sums[kind, name, value][1] += 1 - p
        prior, terms = {}, {}
        for (kind, name, value), (yes, no) in sums.items():
            same = [v for q, v in sums.items() if q[:2] == (kind, name)]
            y, n = sum(v[0] for v in same), sum(v[1] for v in same)
            prior[kind] = math.log((y + 1) / (n + 1))
            terms[kind, name, value] = math.log((yes + 0.5) / (y + 0.5 * len(same))) - math.log((no + 0.5) / (n + 0.5 * len(same)))
        return prior, terms

    def logistic(x):
        return 1 / (1 + math.exp(-x))

    named = [(kind, list(zip(P.LABELERS, map(str, votes))), [tuple(f.split("=", 1)) for f in features], logistic(sum(votes) + votes[0] - 0.5)) for kind, votes, features in rows]
    p = [r[3] for r in named]
    for _ in range(P._STEPS):
        prior, terms = fit([(r[0], r[1], q) for r, q in zip(named, p)])
        p = [logistic(prior[r[0]] + sum(terms[r[0], *key] for key in r[1])) for r in named]
    return fit([(r[0], r[2], q) for r, q in zip(named, p)])


def test_estimation_and_classifier(spark):
    store = Store(spark, "test-personal-data")
    found = P.find(spark.read.parquet(f"{SF}/documents.parquet"), store)
    rows = [(r.kind, r.votes, r.features) for r in P.candidates(found).collect()]
    prior, terms = P.classifier(found, *P.estimate(found, store))
    expected_prior, expected_terms = plain(rows)
    assert prior.keys() == expected_prior.keys() and all(abs(prior[k] - expected_prior[k]) < 0.01 for k in prior)
    assert terms.keys() == {f"{k}|{n}={v}" for k, n, v in expected_terms}
    assert all(abs(terms[f"{k}|{n}={v}"] - x) < 0.01 for (k, n, v), x in expected_terms.items())


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_personal_data(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == q for k, _, _ in base) for q in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (P.KINDS.index(s[0]), s[1:]))


def test_no_python_worker(spark):
    plan = P.personal_data(table(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("texts", [[], [None, "", "plain words only"], ["4661596371091201"]])
def test_no_candidates(spark, texts):
    assert all(not base and not added for r in results(spark, texts).values() for base, added in r.values())


def test_clashing_columns_and_ids(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "x", "y"), (1, "1.2.3.4", "x", "y"), (None, "a@b.co", None, None)], "doc_id long, text string, kind string, votes string")
    rows = P.personal_data(docs).collect()
    assert sorted((r.doc_id or 0, len(r.base_email), len(r.base_ip)) for r in rows) == [(0, 1, 0), (1, 0, 1), (1, 1, 0)]
