"""Importance resampling towards a target distribution, with a dictionary of distinct features.

A text's features are its runs of 1 to ``n`` words (lower-cased A-Z; words are runs of ASCII letters and digits and of all
characters above U+007F), repeats counted; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``.

1. One pass over the texts counts the features of each document in its own row; the counts are written once.
2. The dictionary sums those counts by feature string; each distinct string is hashed once.  Buckets are sums of the dictionary.
3. A bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), from the sums s of the corpus and t of the target.
4. Gains go back to the counts by feature.  At most ``frequent`` features can make up more than a ``frequent``-th of all
   occurrences each, so these are broadcast whatever the corpus; the others meet by a shuffle in which no key is large.  Weights of a
   document are added before they are dealt out.
5. Scores add Gumbel noise from the SHA-256 of ``seed:id``; the highest scores among the documents of ``min_words`` words are drawn,
   without replacement: ranges are sorted by themselves and ranks counted on from the ranges before.

Rows: null text has no words, weight 0 and is never drawn; a null id has noise too, from no digits.  Rows that repeat an id are documents
of their own: they share their noise and are ranked one after the other.  An empty target gives all buckets t = 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared_store import Store, release_memory

#: No more features than this are broadcast, nor buckets.
FREQUENT = 100_000
_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {k: k + 32 for k in range(65, 91)}
_COUNTED = "row long, doc_id long, n_words long, n_features long, features array<struct<f: string, c: int>>"


def feature_counts(text: str, n: int) -> tuple[int, Counter]:
    """The number of words, and each feature with its count."""
    words = _WORDS.findall(text.translate(_LOWER))
    counts = Counter(words)
    for size in range(2, n + 1):
        counts.update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return len(words), counts


def _counted(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own for each row, once written), doc_id, n_words, n_features, features."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    entry = pa.struct([("f", pa.string()), ("c", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, ends, strings, numbers = [], [], [0], [], []
            for text in batch["text"]:
                n_words, found = feature_counts(text.as_py(), n)
                strings.extend(found.keys())
                numbers.extend(found.values())
                words.append(n_words)
                features.append(sum(found.values()))
                ends.append(len(strings))
            values = pa.StructArray.from_arrays([pa.array(strings, pa.string()), pa.array(numbers, pa.int32())], fields=list(entry))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(words, pa.int64()), pa.array(features, pa.int64()), listed], ["row", "doc_id", "n_words", "n_features", "features"])
        release_memory()

    return rows.mapInArrow(count, _COUNTED)


def _dictionary(counted: DataFrame, buckets: int) -> DataFrame:
    """f, c, bucket of each distinct feature."""
    entries = counted.select(F.explode("features").alias("e")).select("e.f", "e.c")
    return entries.groupBy("f").agg(F.sum("c").alias("c")).withColumn("bucket", F.pmod(F.crc32(F.col("f").cast("binary")), F.lit(buckets)))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if its rows cannot be more than ``FREQUENT``."""
    return F.broadcast(df) if rows <= FREQUENT else df


def _total(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of every bucket that the corpus's dictionary has; both dictionaries are written tables."""
    here = corpus.groupBy("bucket").agg(F.sum("c").alias("here"))
    there = target.groupBy("bucket").agg(F.sum("c").alias("there"))
    both = here.join(_bounded(there, buckets), "bucket", "left")
    up = (F.coalesce("there", F.lit(0)) + F.lit(1.0)) * F.lit(float(_total(corpus, "c") + buckets))
    down = (F.col("here") + F.lit(1.0)) * F.lit(float(_total(target, "c") + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


def _weights(counted: DataFrame, priced: DataFrame, frequent: int) -> DataFrame:
    """row, weight of every document with features; ``priced`` is the dictionary with gains, written."""
    entries = counted.select("row", F.explode("features").alias("e")).select("row", "e.f", "e.c")
    many = F.col("c") * frequent > _total(priced, "c")
    often, seldom = priced.filter(many).select("f", "gain"), priced.filter(~many).select("f", "gain")
    often = F.broadcast(often) if frequent <= FREQUENT else often
    worth = F.sum(F.col("c") * F.col("gain")).alias("weight")
    quick = entries.join(often, "f").groupBy("row").agg(worth)
    dealt = entries.join(often, "f", "left_anti").join(seldom, "f").groupBy("row").agg(worth)
    return quick.unionByName(dealt).groupBy("row").agg(F.sum("weight").alias("weight"))


def _ranked(rows: DataFrame, store: Store, *order) -> DataFrame:
    """rank: 1, 2, 3 ... in a total order."""
    n = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = store.write(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("own", own).join(F.broadcast(before), "__range").withColumn("rank", (F.col("own") + F.col("before")).cast("long")).drop("own", "before", "__range")


def resample(docs: DataFrame, target: DataFrame, seed: int, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every document."""
    store = Store(docs.sparkSession, "importance")
    counted = store.write(_counted(docs, n, id_col, text_col), "counts")
    wanted = _counted(target.withColumn("__none", F.lit(None).cast("long")), n, "__none", target_text_col)
    corpus = store.write(_dictionary(counted, buckets), "dictionary")
    aims = store.write(_dictionary(wanted, buckets), "target")
    gain = _bounded(gains(corpus, aims, buckets), buckets)
    priced = store.write(corpus.join(gain, "bucket").select("f", "c", "gain"), "priced")
    weight = store.write(_weights(counted, priced, frequent), "weights")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = counted.select("row", "doc_id", "n_words", "n_features").join(weight, "row", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    scored = store.write(scored.withColumn("score", F.col("weight") + noise), "scores")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranks = _ranked(able.select("row", "doc_id", "score"), store, F.desc("score"), F.col("doc_id"), F.col("row")).filter(F.col("rank") <= drawn)
    store.free(counted, corpus, aims, priced, weight)
    return scored.join(ranks.select("row", "rank"), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
