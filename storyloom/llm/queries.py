"""The registered queries of this folder: each applies one operator to its whole table.

A query takes (spark, sf_dir).  ``sf_dir`` may be any path that Spark's readers open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontamination import contamination
from .fill_in_middle import fill_in_middle, restore
from .importance import resample
from .language_mixture import identify
from .language_model import score_texts as score_language
from .line_dedup import dedup_lines
from .ngram_jaccard_join import jaccard_components
from .packing import pack
from .personal_data import KINDS, listed, personal_data
from .suffix_dedup import repeated_passages
from .token_counts import byte_level_pieces, count_pieces
from .toxicity import score_texts
from .vector_search import search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: greedy longest-match pieces of a byte-level vocabulary, the space before each word included."""
    import public_tokenizers

    first, within = byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json"))
    return count_pieces(_table(spark, sf_dir, "documents"), first, within, lead=b" ")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels where crc32(doc_id) mod 5 is not 0."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    labels = _table(spark, sf_dir, "labels").filter(F.col("toxic").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return score_texts(docs, labels, keep=("doc_id", "held_out"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest rows of each row whose vec_id is divisible by 100."""
    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text without the removed lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs; learns where crc32(doc_id) mod 4 is not 2."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)))
    return identify(docs, docs.filter("not held_out and lang is not null"), keep=("doc_id", "held_out"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; learns where crc32(doc_id) mod 7 is not 2."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False)))
    return score_language(docs, docs.filter("not held_out"), keep=("doc_id", "held_out"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: windows of 1024 ids."""
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: distinct 4-word shingles, links at 85 of 100."""
    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_repeated, spans: passages of 50 words or more that another document has too."""
    return repeated_passages(_table(spark, sf_dir, "documents"), min_words=50)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: windows of 10 item words."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a tenth of the documents of 20 words or more, drawn towards the benchmark's words."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), seed=2024, n=1, buckets=10_000, percent=10, min_words=20)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: texts cut between lines."""
    cut = fill_in_middle(_table(spark, sf_dir, "documents"), seed=7, unit="lines", rate=100, spm=50)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base spans and those that the classifier adds)."""
    found = personal_data(_table(spark, sf_dir, "documents"))
    base = [F.col(f"base_{k}") for k in KINDS]
    every = [F.concat(f"base_{k}", f"added_{k}") for k in KINDS]
    counts = [F.size(b).cast("long").alias(f"n_{k}") for k, b in zip(KINDS, base)]
    return found.select("doc_id", *counts, F.sha2(listed(*base), 256).alias("base_sha256"), listed(*every).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_vector_search": op3_vector_search,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_mixture": op5_language_mixture,
    "op6_language_model": op6_language_model,
    "op7_packing": op7_packing,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_personal_data": op13_personal_data,
}
