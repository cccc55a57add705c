"""Repeated passages by a sparse suffix array.

Words are runs of bytes other than ASCII white space, A-Z lower-cased.  A passage of ``min_words`` or more words that stands in two
documents is found in both, wherever it stands.

1. Sampling: of every ``WINDOW`` neighbouring ``GRAM``-word grams the one of least hash is selected, by content alone, so equal
   passages select the same places.  Only the suffixes there are retained, about 2 / (WINDOW + 1) of all.
2. A run of ``min_words`` words has a selected place among its first WINDOW, and from there at least ``min_words - WINDOW + 1``
   words are shared.  Suffixes whose first so many words start no suffix of another document are left out (partial aggregation).
3. The rest carry ``min_words`` words to the right and to the left (two bytes a word).  They are dealt out by their first words, which
   start at most ``NEIGHBOURS`` + 1 suffixes, and sorted by their right and left contexts.
4. Each suffix is compared with the ``NEIGHBOURS`` before and after it and matches are extended right and left; matches of at least
   ``min_words`` words count.  That is all pairs, as suffixes whose first words start more others do not take part in 3 and 4: of these
   every window of ``min_words`` words around the place is hashed, and windows of two documents count (partial aggregation).
5. The places covered are merged to spans of each document.

Rows: a null or short text has no spans.  Repeats within one document do not count.  Rows repeated with one doc_id are one
document; of different texts, that of the smallest hash stands for it in each of its rows.  A row of null doc_id takes no part and has no spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .links import partitions_for
from .shared_store import Store, one_text_each
from .wordhash import U64, list_array, mix64, ngram_hashes, text_chunks, word_hashes

MIN_WORDS = 50
WINDOW, GRAM = 25, 8
NEIGHBOURS = 24
#: Ids that may be sent to every executor (8 bytes each); beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 200_000


def selected_places(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The first place of least gram hash in each window of grams; a text of fewer grams selects none."""
    grams = mix64(ngram_hashes(words, gram))
    if len(grams) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(views.argmin(1) + np.arange(len(views)))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place, from a running polynomial sum modulo 2**64."""
    if len(words) < n:
        return np.zeros(0, U64)
    base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64)
    up, down = np.full(len(words) + 1, base, U64), np.full(len(words) + 1, inverse, U64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(mix64(words) * up[:-1], out=total[1:])
    return mix64((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def _places(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    shared = min_words - WINDOW + 1
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, raw, offsets in text_chunks(batch.column(1)):
            words, first = word_hashes(raw, offsets)
            at, keys, counts = [], [], np.zeros(hi - lo, np.int64)
            runs = run_hashes(words, shared)
            for k in range(hi - lo):
                own = words[first[k] : first[k + 1]]
                if len(own) >= min_words:
                    p = selected_places(own)
                    p = p[p + shared <= len(own)]
                    at.append(p)
                    keys.append(runs[first[k] + p])
                    counts[k] = len(p)
            at, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, keys))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), list_array(at.astype(np.int32), counts), list_array(keys.view(np.int64), counts)], names=["doc_id", "n_words", "at", "keys"]
            )


def _windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, at -> a row for each window of min_words words that begins at most WINDOW - 1 words before one of the places."""
    for batch in batches:
        ids, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        starts, places = at.offsets.to_numpy(), at.values.to_numpy()
        for lo, hi, raw, offsets in text_chunks(batch.column(1)):
            words, first = word_hashes(raw, offsets)
            runs = run_hashes(words, min_words)
            for k in range(lo, hi):
                p = places[starts[k] : starts[k + 1]].astype(np.int64)
                begin = np.unique(p[:, None] - np.arange(WINDOW))
                begin = begin[(begin >= 0) & (begin + min_words <= first[k - lo + 1] - first[k - lo])]
                if len(begin):
                    hashes = runs[first[k - lo] + begin].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(begin), ids[k], np.int64)), pa.array(begin.astype(np.int32))], names=["window", "doc_id", "start"])


def _contexts(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, at -> a row for each place: right and left context, nearest word first."""
    m = min_words
    for batch in batches:
        ids, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        starts, places = at.offsets.to_numpy(), at.values.to_numpy()
        for lo, hi, raw, offsets in text_chunks(batch.column(1)):
            words, first = word_hashes(raw, offsets)
            for a in range(lo, hi, 64):
                rows = range(a, min(a + 64, hi))
                rights, lefts, docs, own_places = [], [], [], []
                for k in rows:
                    p = places[starts[k] : starts[k + 1]].astype(np.int64)
                    if not len(p):
                        continue
                    own = words[first[k - lo] : first[k - lo + 1]]
                    # 1 to 65535 for words, 0 beyond the text.
                    short = np.concatenate([np.zeros(m, ">u2"), ((own >> U64(40)) % U64(65535) + U64(1)).astype(">u2"), np.zeros(m, ">u2")])
                    rights.append(short[(p + m)[:, None] + np.arange(m)])
                    lefts.append(short[(p + m)[:, None] - 1 - np.arange(m)])
                    docs.append(np.full(len(p), ids[k]))
                    own_places.append(p)
                if docs:
                    fixed = lambda x: pa.array([r.tobytes() for r in np.concatenate(x)], pa.binary())
                    yield pa.RecordBatch.from_arrays([fixed(rights), fixed(lefts), pa.array(np.concatenate(docs).astype(np.int64)), pa.array(np.concatenate(own_places).astype(np.int32))], names=["right", "left", "doc_id", "at"])


def _equal_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the rows of a and b share from their start; the zeros beyond a text do not count."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], same.argmin(1))


def _compare(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes -> doc_id, start, stop of the matches."""
    m, near = min_words, NEIGHBOURS
    columns = None
    for batch in batches:
        if not batch.num_rows:
            continue
        right, left = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(-1, m) for k in (0, 1))
        doc, at = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        fresh = (right, left, doc, at, np.full(len(doc), -1), np.full(len(doc), -1))
        done = 0 if columns is None else len(columns[2])
        columns = fresh if columns is None else tuple(np.concatenate(x) for x in zip(columns, fresh))
        right, left, doc, at, best_l, best_r = columns
        for s in range(1, near + 1):  # pairs within the first ``done`` rows have been compared
            i = np.arange(max(0, done - s), len(doc) - s)
            i = i[doc[i] != doc[i + s]]
            r, l = _equal_prefix(right[i], right[i + s]), _equal_prefix(left[i], left[i + s])
            ok = r + l >= m
            for x in (i, i + s):
                np.maximum.at(best_l, x[ok], l[ok])
                np.maximum.at(best_r, x[ok], r[ok])
        cut = max(0, len(doc) - near)
        yield _matches(doc[:cut], at[:cut], best_l[:cut], best_r[:cut])
        columns = tuple(c[cut:] for c in columns)
    if columns is not None:
        yield _matches(*columns[2:])


def _matches(doc, at, best_l, best_r) -> pa.RecordBatch:
    hit = best_r >= 0
    return pa.RecordBatch.from_arrays([pa.array(doc[hit].astype(np.int64)), pa.array((at - best_l)[hit].astype(np.int32)), pa.array((at + best_r)[hit].astype(np.int32))], names=["doc_id", "start", "stop"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_repeated (words in passages that another document has), spans (start and stop word of each) of every document."""
    spark = docs.sparkSession
    store = Store(spark, "suffixes")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = texts.filter("doc_id is not null")
    chosen = one_text_each(named, store)
    places = store.write(chosen.unionByName(texts.filter("doc_id is null")).mapInArrow(partial(_places, min_words=min_words), "doc_id long, n_words long, at array<int>, keys array<long>"), "places")
    suffixes = places.filter("doc_id is not null").select("doc_id", F.explode(F.arrays_zip("at", "keys")).alias("x")).select("doc_id", F.col("x.at").alias("at"), F.col("x.keys").alias("key"))
    repeated = suffixes.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", (F.col("n") > NEIGHBOURS + 1).alias("many"))
    repeated = store.write(repeated, "repeated")
    at = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("at"))))
    kept = store.write(suffixes.join(repeated, "key").select("doc_id", "at", "many").distinct().groupBy("doc_id").agg(at(~F.col("many")).alias("few"), at(F.col("many")).alias("many")), "kept")

    def texts_at(which: str) -> DataFrame:
        own = kept.filter(F.size(which) > 0).select("doc_id", F.col(which).alias("at"))
        held = F.broadcast(own.select("doc_id")) if own.count() <= BROADCAST_IDS else own.select("doc_id")
        return chosen.join(held, "doc_id", "left_semi").dropDuplicates(["doc_id"]).join(own, "doc_id").select("doc_id", "text", "at")

    windows = store.write(texts_at("many").mapInArrow(partial(_windows, min_words=min_words), "window long, doc_id long, start int"), "windows")
    common = store.write(windows.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("window"), "common")
    inside = store.write(windows.join(common, "window", "left_semi").select("doc_id", "start", (F.col("start") + min_words).alias("stop")), "inside")
    store.free(windows, common)
    store.settle()
    rows = texts_at("few").mapInArrow(partial(_contexts, min_words=min_words), "right binary, left binary, doc_id long, at int")
    first_words = F.substring("right", 1, 2 * (min_words - WINDOW + 1))  # two bytes a word
    sorted_rows = rows.repartition(partitions_for(rows), first_words).sortWithinPartitions("right", "left", "doc_id", "at")
    found = store.write(sorted_rows.mapInArrow(partial(_compare, min_words=min_words), "doc_id long, start int, stop int"), "found")
    store.settle()
    spans = found.unionByName(inside).distinct()
    own = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.coalesce(F.col("start") <= before, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(own))
    spans = spans.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = spans.groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("n_repeated"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    spans = store.write(spans, "spans")
    store.keep_only(places, spans)
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    sizes = places.select("doc_id", "n_words")
    if chosen is not named:  # each row of a repeated id gets what its chosen text has
        sizes = named.select("doc_id").join(sizes.distinct(), "doc_id").unionByName(sizes.filter("doc_id is null"))
    return sizes.join(spans, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"), F.coalesce("spans", nothing).alias("spans"))
