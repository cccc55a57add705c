"""The lines that line_dedup removes, against all pairs."""

import random
import re

import numpy as np
import pytest

from storyloom.llm import buckets, line_dedup, queries

FORM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def form(line):
    return " ".join(FORM.findall(line.translate({k: k + 32 for k in range(65, 91)})))


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def features(lines):
    raw = [x.encode() for x in lines]
    bits, blocks, per_word = line_dedup.sketch_shape(len(lines))
    found = line_dedup.line_features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), -(-blocks // per_word))
    return found, bits, blocks, per_word


def similar_pairs(lines, candidate):
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            most = int(0.2 * max(len(a), len(b)) + 1e-6)
            if abs(len(a) - len(b)) <= most and candidate(i, j) and line_dedup.edits(a, b) <= most:
                yield i, j


def similar_pairs_of(lines, close):
    """Of the pairs (i, one of close[i]) the similar ones."""
    for i, others in enumerate(close):
        for j in others:
            most = int(0.2 * max(len(lines[i]), len(lines[j])) + 1e-6)
            shared = set(zip(lines[i], lines[i][1:], lines[i][2:])) & set(zip(lines[j], lines[j][1:], lines[j][2:])) if most < 40 else True
            if abs(len(lines[i]) - len(lines[j])) <= most and shared and line_dedup.edits(lines[i], lines[j]) <= most:
                yield i, j


def groups(n, pairs):
    top = list(range(n))

    def of(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in pairs:
        top[of(i)] = of(j)
    return [of(x) for x in range(n)]


def removed(spark, lines):
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    return {r.doc_id for r in got if r["__removed"]}


def test_edits():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(12))) for _ in range(2))
        d = plain_edits(a, b)
        assert line_dedup.edits(a, b) == d
        assert line_dedup.edit_bound(a.split(" "), b.split(" ")) >= d


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def first_lines(docs):
    first = {}
    for k in sorted(docs):
        for n, line in enumerate(docs[k].split("\n")):
            if form(line):
                first.setdefault(form(line), (k, n))
    return first


@pytest.mark.parametrize("members, nearest", [(buckets.MEMBERS, buckets.NEAREST), (3, 1)])
def test_rule(spark, table, monkeypatch, members, nearest):
    """Every pair that agrees in a block, fits in size and distance and is similar is linked, and nothing else, whatever a task holds."""
    monkeypatch.setattr(buckets, "MEMBERS", members)
    monkeypatch.setattr(line_dedup, "link_buckets", lambda *a, **k: buckets.link_buckets(*a, nearest=nearest, **k))
    first = first_lines(table)
    lines = list(first)
    (_, _, _, size, sims), bits, blocks, per_word = features(lines)
    assert size.tolist() == [len(x) for x in lines]
    block = np.array([sims[:, k // per_word] >> np.uint64(k % per_word * bits) & np.uint64((1 << bits) - 1) for k in range(blocks)]).T
    apart = lambda i, j: int(np.bitwise_count(sims[i] ^ sims[j]).sum())
    most = int(line_dedup.DISTANCE * 64 * sims.shape[1])
    group = groups(len(lines), similar_pairs(lines, lambda i, j: (block[i] == block[j]).any() and apart(i, j) <= most))
    stay = {}
    for x, g in zip(lines, group):
        stay[g] = min(stay.get(g, first[x]), first[x])
    stay = set(stay.values())
    for r in queries.op4_line_dedup(spark, "/root/testdata/sf0.001").collect():
        assert r.text == "\n".join(x for n, x in enumerate(table[r.doc_id].split("\n")) if not form(x) or (r.doc_id, n) in stay)


def test_recall(spark):
    """Of the lines of a table that character similarity 0.8 puts into a group with an earlier one, nine in ten go; no condition on words or SimHashes."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 3 = 0").collect()}
    lines = list(first_lines(docs))
    bags = np.array([np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=256) for x in lines], np.int32)
    size = np.array([len(x) for x in lines])
    close = [set(np.flatnonzero((np.abs(bags[:i] - bags[i]).sum(1) <= 0.4 * np.maximum(size[:i], size[i]) + 4)).tolist()) for i in range(len(lines))]
    group = groups(len(lines), similar_pairs_of(lines, close))
    expected = {i for i, g in enumerate(group) if g in group[:i]}
    got = removed(spark, lines)
    assert len(expected) > 20 and got <= expected and len(got) >= 0.9 * len(expected)


def test_no_anchor(spark):
    """Two long words are put into a line of 24, so that the longest words of both differ."""
    rng = random.Random(3)
    lines = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6):06d}" for _ in range(24)]
        lines.append(" ".join(words))
        for _ in range(2):
            words.insert(rng.randrange(len(words)), f"insertedlongword{rng.randrange(10**6):06d}")
        lines.append(" ".join(words))
    got = removed(spark, lines)
    assert got <= set(range(1, 80, 2)) and len(got) >= 36


def test_letter_in_a_short_line(spark):
    """One letter of four words: similar by characters, not by words.  Blocks find a part of such lines."""
    rng = random.Random(9)
    lines = []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(4)]
        lines.append(" ".join(words))
        words[k % 4] = "0" + words[k % 4][1:]
        lines.append(" ".join(words))
    got = removed(spark, lines)
    assert got <= set(range(1, 120, 2)) and len(got) >= 15


def test_one_id_with_several_texts(spark):
    rows = [(1, "one line of words that stays"), (1, "another text of the same id\none line of words that stays"), (2, "another text of the same id"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text or "") for r in line_dedup.dedup_lines(docs).collect())
    assert got[2][0] == 2 and [x for _, t in got for x in t.split("\n") if x].count("another text of the same id") == 1
    assert [x for _, t in got for x in t.split("\n") if x].count("one line of words that stays") == 1
