"""Passages of more places than the neighbourhood of suffix_dedup, held against all windows of 50 words."""

import random
from collections import defaultdict

import numpy as np

from storyloom.llm import suffix_dedup
from storyloom.llm.wordhash import mix64, ngram_hashes, word_hashes


def ngram_hash(raw):
    return mix64(ngram_hashes(word_hashes(raw, np.array([0, len(raw)]))[0], suffix_dedup.GRAM))


def check(spark, texts):
    seen = defaultdict(set)
    words = {k: t.split() for k, t in texts.items()}
    for k, w in words.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(k)
    for r in suffix_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        w = words[r.doc_id]
        expected = {j for i in range(len(w) - 49) if len(seen[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}
        assert {j for a, b in r.spans for j in range(a, b)} == expected and r.n_repeated == len(expected)


def test_one_document_many_times(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    check(spark, {1: " and so on ".join([passage] * 150), 2: "before " + passage})


def test_frequent_right_side(spark):
    """Passages of 52 words; the last 37, whose third place is selected before others, are in 300 other documents too."""
    rng = random.Random(2)
    word = lambda: f"x{rng.randrange(10**9)}"
    some = lambda n: [word() for _ in range(n)]
    raw = lambda words: np.frombuffer(" ".join(words).encode(), np.uint8)
    third = lambda words: ngram_hash(raw(words))[2]
    right = min((some(37) for _ in range(2000)), key=third)
    texts = {k: [*some(60), *right, *some(60)] for k in range(300)}
    for k in range(100):
        left = some(15)
        for doc in (1000 + 2 * k, 1001 + 2 * k):
            texts[doc] = [*some(60), *left, *right, *some(60)]
    check(spark, {k: " ".join(w) for k, w in texts.items()})
