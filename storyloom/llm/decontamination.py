"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

Words are runs of ASCII letters and digits and of all characters above U+007F, after lower-casing
A-Z.  An item's windows are its runs of ``window`` consecutive words; an item of fewer words is one
window, an item without words has none.  A document word inside any occurrence of a window is hit.

1. A window is a set of word shingles of ``SHINGLE`` words (a shorter window is one shingle).  To hold
   a window a document must hold every one of its shingles, so the necessary prefix, shingles
   ordered by rarity, has length one: the window's rarest shingle.
2. Rarity is counted over the whole corpus: every document shingle that is also a benchmark shingle
   is a match (document, position, shingle), written once; counts come from partial aggregates.
3. Matches of a window's rarest shingle give candidate places.  Positional bounds (the window starts
   at or after word 0) and length bounds (it ends within the document) apply in the join.
4. Each candidate is verified word by word on the document's text.

Rows: null or empty text and text without words have no words and no hits.  Document ids are
expected to be unique; rows repeated with one id share the union of their hits.  Item ids may repeat.
A benchmark without words contaminates nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared_store import Store

#: Words of a shingle: long enough to be rare, short enough that most windows have several.
SHINGLE = 3
#: Rows of benchmark shingles, or document ids, that may be broadcast (tens of bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item_id, key (the window's words joined by spaces), len; distinct."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    w = w.select("item_id", "w", F.explode(starts).alias("i"))
    cut = F.slice("w", F.col("i"), F.lit(window))
    return w.select("item_id", F.array_join(cut, " ").alias("key"), F.size(cut).alias("len")).distinct()


def _shingles(of_words: str, k: int) -> Column:
    """array of structs of k neighbouring words, one for each position; the last k - 1 hold nulls."""
    names = [f"w{j}" for j in range(k)]
    shifted = [F.slice(F.col(of_words), j + 1, F.greatest(F.size(of_words) - j, F.lit(0))).alias(n) for j, n in enumerate(names)]
    return F.arrays_zip(*shifted)


def _shingle_rows(df: DataFrame, of_words: str, k: int, *keep: str) -> DataFrame:
    """keep, pos, shingle (64-bit hash of k words) for each place of ``of_words`` that has k words."""
    placed = df.select(*keep, F.posexplode(_shingles(of_words, k)).alias("pos", "s"))
    return placed.filter(F.col(f"s.w{k - 1}").isNotNull()).select(*keep, "pos", F.xxhash64(F.lit(k), *[F.col(f"s.w{j}") for j in range(k)]).alias("shingle"))


def occurrences(docs: DataFrame, windows: DataFrame, store: Store, id_col: str, text_col: str) -> DataFrame:
    """doc_id, start, len, key of each place where a window (key, len) stands in a document."""
    distinct = store.write(windows.select("key", "len").distinct(), "windows")
    split = distinct.withColumn("w", F.split("key", " ")).withColumn("k", F.least("len", F.lit(SHINGLE)))
    kinds = sorted(r[0] for r in split.select("k").distinct().collect())  # at most SHINGLE values
    if not kinds:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("key")).filter("false")
    parts = [_shingle_rows(split.filter(F.col("k") == k), "w", k, "key", "len") for k in kinds]
    shingles = parts[0]
    for p in parts[1:]:
        shingles = shingles.unionByName(p)
    shingles = store.write(shingles, "shingles")
    wanted = _small(store.write(shingles.select("shingle").distinct(), "wanted"))
    texts = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    texts = texts.withColumn("n", F.size("w"))
    found = None
    for k in kinds:
        rows = _shingle_rows(texts, "w", k, "doc_id", "n").join(wanted, "shingle", "left_semi")
        found = rows if found is None else found.unionByName(rows)
    found = store.write(found, "matches")
    rarity = found.groupBy("shingle").count()
    anchor = shingles.join(rarity, "shingle").groupBy("key", "len").agg(F.min(F.struct("count", "shingle", "pos")).alias("a"), F.count("*").alias("present"))
    # A window whose shingles do not all occur in the corpus stands nowhere.
    anchor = anchor.filter(F.col("present") == F.col("len") - F.least("len", F.lit(SHINGLE)) + 1)
    anchor = _small(store.write(anchor.select("key", "len", F.col("a.shingle").alias("shingle"), F.col("a.pos").alias("at")), "anchors"))
    places = found.join(anchor, "shingle").withColumn("start", F.col("pos") - F.col("at"))
    places = places.filter("start >= 0 and start + len <= n").select("doc_id", "start", "len", "key")
    places = store.write(places.distinct(), "candidates")
    held = _small(store.write(places.select("doc_id").distinct(), "held"))
    with_words = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).join(held, "doc_id", "left_semi")
    listed = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "key")).alias("p"))
    checked = with_words.join(listed, "doc_id").select("doc_id", "p", words(F.col("t")).alias("w"))
    true = F.filter("p", lambda x: F.array_join(F.slice("w", x["start"] + 1, x["len"]), " ") == x["key"])
    return checked.select("doc_id", F.explode(true).alias("x")).select("doc_id", "x.start", "x.len", "x.key")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    store = Store(docs.sparkSession, "decontamination")
    windows = store.write(windows_of(items, item_col, item_text_col, window), "item-windows")
    places = store.write(occurrences(docs, windows, store, id_col, text_col), "places")
    store.keep_only(places, windows)
    hit = places.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("p")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    named = places.select("doc_id", "key").distinct().join(windows.select("key", "item_id"), "key").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id").agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    per_doc = hit.join(named, "doc_id", "full")
    out = docs.select(F.col(id_col).alias("doc_id"), F.size(words(F.col(text_col))).cast("long").alias("n_words")).join(per_doc, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark stands; a document without id stays."""
    store = Store(docs.sparkSession, "drop-contaminated")
    windows = store.write(windows_of(items, "item_id", "text", window), "item-windows")
    gone = store.write(occurrences(docs, windows, store, "doc_id", "text").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    store.keep_only(gone)
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
