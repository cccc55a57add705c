"""Importance resampling and fill-in-the-middle against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyloom.llm import fill_in_middle as M
from storyloom.llm import importance, queries

SF = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def grams(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, seed, n, buckets, percent, min_words):
    """rows (doc_id, text) -> sorted rows (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in grams(text, n)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for k, text in docs:
        found = grams(text, n)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def frames(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == plain(docs, target, 2024, 1, 10_000, 10, 20)


DOCS = [(k, " ".join(f"w{k * j % 17}" for j in range(k % 40))) for k in range(60)] + [(100, None), (101, ""), (None, "Ümlaut a-b A B c " * 9), (102, "hot " * 5000), (102, "hot hot"), (7, "same id " * 30)]


@pytest.mark.parametrize("n,frequent,docs,target", [(2, 100_000, DOCS, ["w1 w2 w3", None, "hot a b"]), (1, 4, DOCS, []), (3, 1, [], ["a b"])])
def test_features_and_edges(spark, n, frequent, docs, target):
    """Pairs of words, null ids, repeated ids, an empty target, an empty corpus; features that are not broadcast."""
    a, b = frames(spark, docs, target)
    rows = importance.resample(a.withColumn("row", F.lit("clash")), b, seed=3, n=n, buckets=50, percent=40, min_words=5, frequent=frequent).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == plain(docs, target, 3, n, 50, 40, 5)


def test_equal_rows_are_ranked_one_after_the_other(spark):
    a, b = frames(spark, [(5, "one two three four five")] * 40 + [(6, "one")] * 9, ["one"])
    ranks = sorted(r["rank"] for r in importance.resample(a, b, seed=1, min_words=5, percent=50).collect() if r["rank"])
    assert ranks == list(range(1, 21))


TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "x<S>y\nz", "<P", "a <\nS>\nb", ">\n<\n>\n<", "é😀\r\n x\n" * 50, "\x00\n\x00", "word " * 30_000 + "\nend"]


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def test_lines(spark):
    rows = spark.createDataFrame([(k % 200 if k % 7 else None, t) for k, t in enumerate(TEXTS * 30)], "doc_id long, text string")
    for r in M.fill_in_middle(rows, 7, keep=("doc_id", "text")).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect():
        text = r.text or ""
        units, h = lines(text), hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or any(s in text for s in ("<P>", "<S>", "<M>")) else "spm" if h[3] % 100 < 50 else "psm"
        sizes = (None, None) if form == "plain" else (len(pre), len(mid))
        output = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == (len(units), form, *sizes, output, text)


def test_words_and_rate(spark):
    rows = spark.createDataFrame([(k, "two  words\nand more ") for k in range(400)], "doc_id long, text string")
    got = M.fill_in_middle(rows.withColumn("n", F.lit("clash")), 11, unit="words", rate=40, spm=0).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    assert {r.n for r in got} == {4} and {r.back for r in got} == {"two  words\nand more "}
    assert {r.form for r in got} == {"plain", "psm"} and 0.3 < sum(r.form == "psm" for r in got) / 400 < 0.5
    assert {r.prefix_chars for r in got if r.form == "psm"} <= {0, 5, 11, 15, 20}


def test_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), 7).count() == 0
