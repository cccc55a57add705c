"""Registered queries held against plain Python on whole small tables."""

import glob
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from storyloom.llm import language_model, oracles, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    cursor = db.execute(oracles.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


def test_language_model(spark, docs, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_CHARS", 200_000)  # several buckets and common contexts even here
    got = {r.doc_id: r for r in queries.op6_language_model(spark, SF).collect()}
    words = {k: [*WORD.findall(lower(t).encode()), "end"] for k, t in docs.items()}
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(w for k in train for w in words[k])
    pairs = Counter(p for k in train for p in zip(["start", *words[k]], words[k]))
    total, kinds, after = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, v), c in pairs.items():
        total[u] += c
        kinds[v] += 1
        after[u][min(c, 3) - 1] += 1
    n, v = sum(count.values()), len(count)
    of = lambda c: language_model.discounts([Counter(c.values())[k] for k in (1, 2, 3, 4)])
    upper, low = of(pairs), of(kinds)
    left = sum(low[min(c, 3)] for c in kinds.values()) / len(pairs)

    def prob(a, b):
        back = max(kinds[b] - low[min(kinds[b], 3)], 0) / len(pairs) + left / (v + 1)
        if not total[a]:
            return back
        return max(pairs[a, b] - upper[min(pairs[a, b], 3)], 0) / total[a] + sum(upper[k + 1] * after[a][k] for k in range(3)) / total[a] * back

    assert abs(sum(prob("start", w) for w in [*count, None]) - 1) < 1e-9
    for k, w in words.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert math.isclose(r.score, sum(math.log10(prob(a, b)) for a, b in zip(["start", *w], w)), rel_tol=1e-6)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)


def test_passages(spark, docs):
    words = {k: WORD.findall(lower(t).encode()) for k, t in docs.items()}
    seen = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(k)
    for r in queries.op9_suffix_dedup(spark, SF).collect():
        w = words[r.doc_id]
        expected = {j for i in range(len(w) - 49) if len(seen[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}
        assert {j for a, b in r.spans for j in range(a, b)} == expected and r.n_repeated == len(expected)


def test_search(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding is not None]
    rows = [r for r in rows if np.isfinite(r[1]).all() and r[1].any()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    got = defaultdict(set)
    for r in queries.op3_vector_search(spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.where(ids == q, np.inf, np.sqrt(((x - x[ids == q][0]) ** 2).sum(1)))
        hits.append(len(got[q] & set(ids[np.lexsort((ids, d))[:10]])) / 10)
    assert np.mean(hits) >= 0.9


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    langs = queries.op5_language_mixture(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (langs["lang"] == langs["lang_pred"]).mean() > 0.97
    tox = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    rank, yes = tox["score"].rank(), tox["toxic"] == 1
    assert (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum()) > 0.95


def test_pipeline(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in rows}
    assert kept and kept <= set(docs)
    assert all(docs[k] and re.search(r"[^\W\d_]", docs[k]) for k in kept)
    for k in kept:
        spans = sorted((r.start, r.length) for r in rows if r.doc_id == k)
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:j]) for j in range(len(spans))]
