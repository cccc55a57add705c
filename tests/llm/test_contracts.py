"""The registered queries against plain versions of their contracts, over whole tables."""

import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import decontamination, language_mixture, language_model, line_dedup, ngram_jaccard_join, packing, queries, suffix_dedup, toxicity, vector_search

SF = "/root/testdata/sf0.001"
LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(k, m):
    return zlib.crc32(str(k).encode()) % m


def test_token_counts(spark, docs):
    """Greedy longest match over the whole vocabulary, the space before a word being part of it."""
    letters = packing._byte_letters()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = {bytes(letters[c] for c in p) for p in vocab if all(c in letters for c in p)}
    longest = max(map(len, pieces))

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            size = next((s for s in range(min(longest, len(word) - at), 0, -1) if word[at : at + s] in pieces), 0)
            if not size:
                return None
            at, n = at + size, n + 1
        return n

    for r in queries.op1_token_counts(spark, SF).collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (docs[r.doc_id] or "").encode())
        counts = [greedy(b" " + w) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(1 if c is None else c for c in counts), sum(c is None for c in counts))


def test_toxicity_columns(spark, docs):
    rows = queries.op2_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_exclusive_or(spark):
    """One of two words, not both and not none: no weights of single words can tell."""
    rng = random.Random(2)
    rows = [(k, " ".join([*(w for w, on in (("alpha", k % 4 in (1, 3)), ("omega", k % 4 in (2, 3))) if on), *(f"filler{rng.randrange(40)}" for _ in range(6))])) for k in range(1200)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    labels = many.filter("doc_id < 900").select("doc_id", F.col("doc_id") % 4 % 3 != 0).toDF("doc_id", "label").withColumn("label", F.col("label").cast("int"))
    got = {r.doc_id: r.predicted for r in toxicity.score_texts(many, labels).collect()}
    assert np.mean([got[k] == int(k % 4 in (1, 2)) for k in range(900, 1200)]) > 0.95


def test_language_columns(spark, docs):
    rows = queries.op5_language_mixture(spark, SF).collect()
    known = {r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.lang and fold(r.doc_id, 4) != 2}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id] or "")) and r.lang_pred in known | {"und"}


def test_numbers_are_no_letters(spark):
    texts = ["½", "²", "① Ⅷ", "12 _ 3", "", None, "½ the house", "一"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learn = spark.createDataFrame([("the house is on the hill " * 20, "en"), ("das haus steht am berg " * 20, "de")], "text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_mixture.identify(table, learn).collect()}
    assert [got[k] for k in range(6)] == ["und"] * 6 and got[6] == "en" and got[7] != "und"


def test_language_of_one_long_text(spark):
    learn = spark.createDataFrame([*[(f"the house {k} is on the green hill", "en") for k in range(20)], ("das haus steht am grünen berg " * 60_000, "de")], "text string, lang string")
    assert language_mixture.fit(learn, 100_000).langs == ["de", "en"]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces, fill, padded = defaultdict(list), defaultdict(list), 0
    for r in queries.op7_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == sorted(docs)
    for k, rows in pieces.items():
        ids = [*t.encode(docs[k] or "", add_special_tokens=False).ids, 0]
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == np.cumsum([0, *[r.length for r in rows[:-1]]]).tolist()
        for r in rows:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert sum(r.length for r in rows) == len(ids)
    for spans in fill.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans[:-1]]]).tolist()
        size = sum(n for _, n in spans)
        assert size <= 1024
        padded += 0 if size & (size - 1) == 0 else 1024 - size
    assert padded <= 0.03 * sum(n for s in fill.values() for _, n in s)


def components(ids, pairs):
    top = {k: k for k in ids}

    def of(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = of(a), of(b)
        top[max(x, y)] = min(x, y)
    return {k: of(k) for k in ids}


def test_pipeline_stages(spark):
    """What each stage takes away, by plain versions of their rules on that stage's own input."""
    table = lambda rows: spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_duplicates", "decontamination", "packing"]

    kept = stages["language"](spark, table(rows), SF).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id: r.text for r in kept}.items() <= {r.doc_id: r.text for r in rows}.items()

    worded = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
    lines = stages["line_dedup"](spark, table(kept), SF).collect()
    own = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(kept)).collect()}
    assert {r.doc_id: r.text for r in lines} == {r.doc_id: own[r.doc_id] for r in kept if own[r.doc_id] == r.text or worded.search(own[r.doc_id].translate(LOWER))}

    sets = {}
    for r in lines:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(LOWER))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (both := len(sets[a] & sets[b])) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)]
    group = components(ids, links)
    near = stages["near_duplicates"](spark, table(lines), SF).collect()
    assert {r.doc_id for r in near} == set(group.values())

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = {r.doc_id for r in near if any(tuple(w[i : i + n]) in windows for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))}
    clean = stages["decontamination"](spark, table(near), SF).collect()
    assert dirty and {r.doc_id for r in clean} == {r.doc_id for r in near} - dirty

    packed = stages["packing"](spark, table(clean), SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_five_words_and_eighty_percent(spark, monkeypatch):
    """Groups of near copies around the bound, with buckets that no task holds at once."""
    from storyloom.llm import buckets

    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((6, 30, 90, 300)))]
        for _ in range(rng.randrange(1, 14)):
            other = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 40)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(400)}"
            texts.append(" ".join(other))
    texts += ["", "one", "one", "   "]
    table = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) and 100 * len(a & b) >= 80 * len(a | b)]
    want = components(range(len(texts) + 1), links)
    for members in (buckets.MEMBERS, 4):
        monkeypatch.setattr(buckets, "MEMBERS", members)
        got = {r.doc_id: r.component_id for r in ngram_jaccard_join.jaccard_components(table, n=5, percent=80).collect()}
        assert got == want


def test_vectors_with_repeated_ids(spark):
    rows = [(0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [0.0, 4.0]), (3, None), (4, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.search(table, F.col("vec_id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 3.0)]


def test_vectors_that_are_not_all_reranked(spark):
    """Recall against all pairs where the 200 rows that are scored exactly are one in a hundred."""
    x = np.random.default_rng(5).normal(size=(20_000, 32)).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in vector_search.search(table, F.col("vec_id") % 400 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for q in got:
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits.append(len(got[q] & set(np.lexsort((np.arange(len(x)), d))[:10].tolist())) / 10)
    assert len(hits) == 50 and np.mean(hits) >= 0.9


def test_model_with_an_empty_bucket(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_CHARS", 200)
    table = spark.createDataFrame([(0, "a b " * 500), (1, "b b a q a a")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_texts(table, table.filter("doc_id = 0")).collect()}
    assert got[1].n_tokens == 7 and got[1].n_known == 6 and np.isfinite(got[1].score)


def test_items_without_an_id(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, "one two three four five six seven eight nine ten")], "item_id long, text string")
    r = decontamination.contamination(spark.createDataFrame([(7, "x one two three four five six seven eight nine ten")], "doc_id long, text string"), items).first()
    import hashlib

    assert (r.n_items, r.n_hit, r.items_sha256) == (1, 10, hashlib.sha256(b"1").hexdigest())


def test_one_id_with_several_texts(spark):
    long = " ".join(f"w{k}" for k in range(120))
    table = spark.createDataFrame([(1, long), (1, "short text"), (2, long), (3, long + " end"), (4, None), (4, "")], "doc_id long, text string")
    got = ngram_jaccard_join.jaccard_components(table).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4, 4] and len({(r.doc_id, r.component_id) for r in got}) == 4
    spans = suffix_dedup.repeated_passages(table).collect()
    assert sorted(r.doc_id for r in spans) == [1, 1, 2, 3, 4, 4] and len({(r.doc_id, r.n_repeated) for r in spans}) == 4


def test_clashing_names(spark):
    table = spark.createDataFrame([(1, "some words to read", "w", 5, "k"), (2, None, None, None, None)], "doc_id long, text string, key string, size long, sketch string")
    from storyloom.llm import token_counts

    assert token_counts.count_pieces(table, [b"a"], [b"a"]).count() == 2
    assert language_model.score_texts(table, table).count() == 2
    assert suffix_dedup.repeated_passages(table).count() == 2
    assert packing.pack(table, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024).filter("doc_id = 2").count() == 1
    assert toxicity.score_texts(table, table.select("doc_id", F.lit(1).alias("label"))).count() == 2
    assert line_dedup.dedup_lines(table).select("key", "size", "sketch").count() == 2
