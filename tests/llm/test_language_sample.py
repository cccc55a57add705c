"""The bounded sample that languages are learned from leaves no language out."""

from storyloom.llm import language_mixture


def test_copies_of_one_text(spark):
    """Each language's labelled text is copies of one text longer than the bound; both are learned."""
    en, de = "the cat and the dog were here " * 40, "der hund und die katze waren hier " * 40
    labelled = spark.createDataFrame([(en, "en"), (de, "de")] * 20, "text string, lang string")
    docs = spark.createDataFrame([(1, "the dog and the cat were here"), (2, "die katze und der hund waren hier")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_mixture.identify(docs, labelled, sample_chars=10).collect()} == {1: "en", 2: "de"}
