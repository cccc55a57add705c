"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

from storyloom.llm import decontamination, language_mixture, language_model, line_dedup, ngram_jaccard_join as jaccard, packing, suffix_dedup, token_counts, toxicity, vector_search

LONG = " ".join(f"w{k * 7919 % 5003}" for k in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five"), (5, "one two three four five"), (5, "one two three four five"), (6, LONG), (7, LONG + " tail"), (8, "ünïcödé ßtraße 東京 🙂"), (None, "no id here"), (9, "123 456 !!!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"n": F.lit("clash"), "id": F.lit(5), "component": F.lit(1.5), "kept": F.lit(None).cast("string")})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_jaccard(docs):
    got = by_id(jaccard.jaccard_components(docs))
    assert [got[k].n_shingles for k in (1, 2, 3, 4, 8)] == [0, 0, 0, 2, 1]
    assert [got[k].component_id for k in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 3, 4, 4, 6, 6]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard.keep_one_of_each(docs, jaccard.jaccard_components(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]


def test_lines(docs, spark):
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert (1, None) in got and (3, " \n\t ") in got and (None, "no id here") in got and (5, "") in got and (4, "one two three four five") in got
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    kept = line_dedup.keep_deduplicated(docs)
    assert kept.columns == docs.columns and 5 not in {r.doc_id for r in kept.collect()}


def test_contamination(docs, spark):
    items = spark.createDataFrame([(1, "two three"), (2, None), (3, "!!"), (1, "two three"), (4, "three four five six"), (5, "ÜNÏCÖDÉ")], "item_id long, text string")
    got = by_id(decontamination.contamination(docs, items))
    assert (got[4].n_words, got[4].n_hit, got[4].n_items, got[4].contaminated) == (5, 2, 1, True)
    assert got[1].n_words == 0 and got[1].items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert not got[8].contaminated  # only A-Z is lower-cased
    assert not any(r.contaminated for r in decontamination.contamination(docs, items.limit(0)).collect())
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.drop_contaminated(docs, items).columns == docs.columns


def test_languages(docs, spark):
    labelled = spark.createDataFrame([("the cat and the dog were here", "en"), ("der hund und die katze waren hier", "de")] * 5, "text string, lang string")
    got = by_id(language_mixture.identify(docs, labelled))
    assert [got[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4 and got[1].score == 0
    assert language_mixture.identify(docs, labelled.limit(0)).filter("lang_pred <> 'und'").count() == 0
    kept = language_mixture.keep_identified(docs, labelled)
    assert kept.columns == docs.columns and kept.count() == 7
    told = language_mixture.identify(spark.createDataFrame([(1, "the dog and the cat the dog and the cat " * 9 + "der hund und die katze " * 8)], "doc_id long, text string"), labelled).first()
    assert set(told.langs) == {"en", "de"} and told.lang_pred == "en" and 0.5 < told.score < 0.8


def test_toxicity(docs, spark):
    many = spark.createDataFrame([(k, f"clean words number x{k}" + (" you idiot" if k % 3 == 0 else "")) for k in range(300)], "doc_id long, text string")
    labels = many.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("label"))
    got = by_id(toxicity.score_texts(many.unionByName(spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string")), labels))
    assert all(got[k].predicted == (k % 3 == 0) for k in range(300)) and 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    assert toxicity.score_texts(docs, labels.limit(0)).count() == len(TEXTS)
    assert toxicity.score_texts(docs.limit(0), labels).count() == 0


def test_pairs_of_terms(spark):
    """A pair that neither term gives away: the score of both together is above either alone."""
    rows = [(k, " ".join(w for w, on in (("aaa", k % 4 in (1, 3)), ("bbb", k % 4 in (2, 3))) if on) + " filler") for k in range(800)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(toxicity.score_texts(many, many.select("doc_id", (F.col("doc_id") % 4 == 3).cast("int").alias("label"))))
    assert got[3].predicted == 1 and got[1].predicted == got[2].predicted == got[4].predicted == 0


def test_language_model(docs):
    got = by_id(language_model.score_texts(docs, docs.filter("doc_id = 4")))
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[4].n_tokens == 6 == got[4].train_tokens
    assert got[4].score > got[4].base_score and got[6].n_known == 1
    assert language_model.score_texts(docs, docs.limit(0)).count() == len(TEXTS)
    assert language_model.score_texts(docs.limit(0), docs).count() == 0


def test_packing(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, with_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) <= 1024
    assert [r.doc_tokens for r in rows if r.doc_id == 1] == [1]
    assert packing.pack(docs.limit(0), path).count() == 0


def test_window_filling():
    for counts in ({1000: 3, 24: 2, 10: 5}, {513: 4, 511: 4}, {700: 2, 300: 3, 20: 9}, {k: 1 for k in range(1, 1024)}):
        slots = packing.plan_windows(counts, 1024)
        assert {k: sum(b - a for length, a, b, *_ in slots if length == k) for k in counts} == counts
    import itertools

    pieces = [700, 333, 300, 222, 111, 50, 24]
    best = max(700 + sum(c) for n in range(7) for c in itertools.combinations(pieces[1:], n) if 700 + sum(c) <= 1024)
    used = packing.fill_window({p: 1 for p in pieces}, 700, 1024)
    assert sum(k * n for k, n in used.items()) == best


def test_special_strings():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        t = packing.ByteTokenizer(f.read())
    for text in ("a <|endoftext|> b", "naïve  café\n\n 日本", "\u0085 x y  ", "🙂🙃", "'tis I'll", "١٢٣"):
        assert t.ids(text).tolist() == t.slow.encode(text, add_special_tokens=False).ids


def test_pieces(docs):
    pieces = [b"un", b"aff", b"able", b"a"], [b"aff", b"able", b"a", b"ble", b"b", b"l", b"e", b"f"]
    automaton = token_counts.PieceAutomaton(*pieces)

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            fits = [p for p in (pieces[0] if at == 0 else pieces[1]) if word.startswith(p, at)]
            if not fits:
                return 0
            at += len(max(fits, key=len))
            n += 1
        return n

    import itertools

    for n in range(1, 7):
        for letters in itertools.product(b"unafble"[2:], repeat=n):
            assert automaton.count(bytes(letters)) == greedy(bytes(letters)), letters
    assert automaton.count(b"unaffable") == 3
    got = by_id(token_counts.count_pieces(docs, *pieces))
    assert got[1].n_words == 0 and got[4].n_words == 5 == got[4].n_unknown


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("near", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id) for r in vector_search.search(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert vector_search.search(df.limit(0), F.lit(True)).count() == 0


def test_passages(docs, spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"{k}x{j}" for j in range(40)) + " " + passage + " " + " ".join(f"{k}y{j}" for j in range(40))) for k in range(30)] + [(99, " ".join(f"z{j}" for j in range(300)))]
    got = by_id(suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all([tuple(s) for s in got[k].spans] == [(40, 100)] for k in range(30)) and got[99].n_repeated == 0
    got = by_id(suffix_dedup.repeated_passages(docs))
    assert got[1].n_words == 0 and got[6].n_repeated == 30_000 and got[7].n_words == 30_001
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0
