"""N-gram Jaccard join by parity sketches.

Every text becomes its set of distinct word n-grams (lower-cased A-Z, words are runs of bytes
other than ASCII white space; a text of fewer words is one n-gram, a text without words has
an empty set).  Two texts link when ``100 * |A & B| >= percent * |A | B|``.

1. Size bands.  Linked sets have sizes within ``percent / 100`` of each other, so each set takes
   part in the band of its own size and in the next one if a larger partner may lie there.
2. Parity sketch.  Each n-gram hash flips one bit.  An n-gram in only one of two sets flips one bit of one
   sketch, so the sketches' Hamming distance is at most the symmetric difference.  In a band, the hash also picks
   one of ``blocks`` blocks, and blocks that hold different n-grams are at most as many.  Linked sets in the band
   differ in at most D n-grams.
3. Pigeonhole.  With more than D blocks, linked sets hold the very same n-grams in at least one
   block.  A block's key is the XOR of its n-grams' 64-bit hashes (equal if the block's n-grams
   are, whatever the width of its bit sketch).  Blocks of few n-grams say little, and empty ones nothing: a set leaves out all blocks
   of fewer than s n-grams, s as large as it can be (up to ``WEAK``) with so few such blocks that another agreeing one must remain.
   Of two linked sets the one with the larger s has an agreeing block of s n-grams or more, which the other has kept as well.
4. Members of a bucket are compared by bit sketches whose size follows that of the set (up to ``WIDEST`` words), nearest first; the
   near pairs are verified on the sets, linked ones contracted to groups, and pairs across groups
   compared until none is untested (``buckets``).  No bucket is ever expanded into all its pairs and none is cut short.

Rows: a null or blank text has an empty set, links with nothing, and is its own component.  Rows
repeated with the same doc_id count as one document; of different texts, that of the smallest hash
stands for it in each of its rows.  A row with a null doc_id takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .buckets import link_buckets
from .links import extended, key_runs
from .shared_store import Store, one_text_each, release_memory
from .wordhash import U64, doc_of, list_array, mix64, ngram_hashes, text_chunks, word_hashes

#: Blocks with this many n-grams or more are never left out.
WEAK = 4
#: Ratio of the sizes that a band spans.
BAND_RATIO = 1.4
#: 64-bit words of the sketch that bucket members carry, at most; more pairs of larger sets are verified.
WIDEST = 64
#: Members that each is compared with in the first round.
NEAREST = 8
#: Ids that may be sent to every executor (8 bytes each); beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 200_000


def most_different(sizes, percent: int):
    """The largest symmetric difference of two linked sets whose sizes add up to ``sizes``."""
    return ((100 - percent) * sizes) // (100 + percent)


def bands(percent: int, top: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(low, high, blocks) of each band: sizes from low to high, both included."""
    out, low = [], 1
    while low < top:
        high = max(low, math.ceil(low * BAND_RATIO) - 1)
        d = most_different(2 * high, percent)
        out.append((low, high, 1 if d == 0 else d + 2 + d // 10))
        low = high + 1
    return out


def distinct_ngrams(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, set of each) sorted by set and hash: the distinct n-grams of each text."""
    words, first = word_hashes(raw, offsets)
    docs, counts = doc_of(first), np.diff(first)
    grams = ngram_hashes(words, n)
    fits = docs[: len(grams)] == docs[n - 1 :] if len(grams) else np.zeros(0, bool)
    hashes, owners = [grams[fits]], [docs[: len(grams)][fits]]
    for short in range(1, n):
        at = first[:-1][counts == short]
        if len(at):
            whole = np.full(len(at), short, U64)
            for k in range(short):
                whole = mix64(whole * U64(0x9FB21C651E98DF25) + words[at + k] + U64(101 + k))
            hashes.append(whole)
            owners.append(np.flatnonzero(counts == short))
    h, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, d


def blocks_of(h: np.ndarray, d: np.ndarray, blocks: np.ndarray):
    """h, d: the n-grams of sets and their set; blocks: of each set -> (set, block, XOR of hashes, parity bits, n-grams) for each block that isn't empty."""
    b = (mix64(h + U64(77)) >> U64(20)) % blocks[d].astype(U64)
    slot = (np.cumsum(blocks) - blocks)[d] + b.astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, h = slot[order], h[order]
    at = np.flatnonzero(np.diff(slot, prepend=-1)) if len(slot) else np.zeros(0, np.int64)
    if len(at) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64), none
    full = slot[at]
    owner = np.searchsorted(np.cumsum(blocks), full, side="right")
    block = full - (np.cumsum(blocks) - blocks)[owner]
    return owner, block, np.bitwise_xor.reduceat(h, at), np.bitwise_xor.reduceat(U64(1) << (h & U64(63)), at), np.diff(at, append=len(slot))


def parity_sketches(h: np.ndarray, d: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sketches of words[k] 64-bit words for each set k, one after another; each n-gram flips one bit.

    The Hamming distance of two sketches is at most the symmetric difference of the sets.  With sizes that are powers of two, the
    XOR of a sketch's halves is the sketch of half the size.
    """
    out = np.zeros(int(words.sum()), U64)
    slot = (np.cumsum(words) - words)[d] + ((h >> U64(6)) % words[d].astype(U64)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, h = slot[order], h[order]
    if len(slot):
        at = np.flatnonzero(np.diff(slot, prepend=-1))
        out[slot[at]] = np.bitwise_xor.reduceat(U64(1) << (h & U64(63)), at)
    return out


def _keys_of_band(h, d, sizes, who, band, low, high, blocks, percent):
    """Keys of the sets ``who`` (indices) in one band -> (set, key)."""
    pick = np.zeros(len(sizes), bool)
    pick[who] = True
    rank = np.cumsum(pick) - 1
    mine = pick[d]
    hh, dd = h[mine], rank[d[mine]]
    nb = np.full(len(who), blocks)
    owner, block, xor, _, size = blocks_of(hh, dd, nb)
    a = sizes[who]
    largest = np.minimum(high, (100 * a) // percent)
    spare = blocks - 1 - most_different(a + largest, percent)  # so many blocks can be left out, and one that agrees remains
    full = np.bincount(owner, minlength=len(who))
    smaller = np.stack([blocks - full, *[blocks - full + np.bincount(owner[size < s], minlength=len(who)) for s in range(2, WEAK + 1)]])  # blocks of fewer than 1, 2, ... n-grams
    least = (smaller <= spare).sum(0)  # numbers of smaller blocks ascend: the largest s that can be afforded
    keep = size >= least[owner]
    keys = mix64(xor + mix64(block.astype(U64) + U64(band << 32)))
    # Sets that cannot leave out their empty blocks have keys for them too.
    fat = np.flatnonzero((least == 0) & (full < blocks))
    if len(fat):
        there = np.zeros((len(fat), blocks), bool)
        at = np.full(len(who), -1)
        at[fat] = np.arange(len(fat))
        sel = at[owner] >= 0
        there[at[owner[sel]], block[sel]] = True
        f, b = np.nonzero(~there)
        more_owner, more_keys = fat[f], mix64(mix64(b.astype(U64) + U64(band << 32)))
        return np.concatenate([who[owner[keep]], who[more_owner]]), np.concatenate([keys[keep], more_keys])
    return who[owner[keep]], keys[keep]


def sketch_keys(h: np.ndarray, d: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all bands that the sets take part in, sorted by set."""
    owners, keys = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    top = int(sizes.max()) if len(sizes) else 0
    for band, (low, high, blocks) in enumerate(bands(percent, 2 * top + 2)):
        # A set of the band below takes part if a linked partner may lie here.  One block: only equal sets link, and those need no keys.
        if blocks == 1:
            continue
        who = np.flatnonzero((sizes <= high) & (sizes >= 1) & (100 * sizes >= percent * low))
        if len(who):
            o, k = _keys_of_band(h, d, sizes, who, band, low, high, blocks, percent)
            owners.append(o)
            keys.append(k)
    o, k = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(o, kind="stable")
    return o[order], k[order]


def _signatures(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, raw, offsets in text_chunks(batch.column(1)):
            h, d = distinct_ngrams(raw, offsets, n)
            sizes = np.bincount(d, minlength=hi - lo).astype(np.int64)
            f1, f2 = np.zeros(hi - lo, U64), np.zeros(hi - lo, U64)
            some = np.flatnonzero(sizes)
            if len(some):
                at = np.flatnonzero(np.diff(d, prepend=-1))
                f1[some], f2[some] = np.add.reduceat(h, at), np.bitwise_xor.reduceat(mix64(h + U64(5)), at)
            owner, key = sketch_keys(h, d, sizes, percent)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), list_array(key.view(np.int64), np.bincount(owner, minlength=hi - lo))],
                names=["doc_id", "n_shingles", "f1", "f2", "keys"],
            )
    release_memory()


def member_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of a set's sketch: a power of two, one to two bits for each n-gram and 512 at least."""
    return np.minimum(WIDEST, 1 << np.ceil(np.log2(np.maximum(sizes / 64, 8))).astype(np.int64)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """id, n, grams (sorted hashes), sketch."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, raw, offsets in text_chunks(batch.column(1)):
            h, d = distinct_ngrams(raw, offsets, n)
            sizes = np.bincount(d, minlength=hi - lo).astype(np.int64)
            width = member_words(sizes)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(sizes), list_array(h.view(np.int64), sizes), list_array(parity_sketches(h, d, width).view(np.int64), width)], names=["id", "n", "grams", "sketch"]
            )
    release_memory()


def smallest_partner(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The least size of a set that a set of this size may be linked with."""
    return -(-percent * sizes // 100)


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, grams_a, grams_b (sorted, distinct) -> the pairs that link."""
    for batch in batches:
        ga, gb = batch.column(2), batch.column(3)
        oa, ob = ga.offsets.to_numpy(), gb.offsets.to_numpy()
        va, vb = ga.values.to_numpy(), gb.values.to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[i] = 100 * shared >= percent * (len(a) + len(b) - shared)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])
    release_memory()


def links_among(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the sets themselves; only the sets of the pairs are moved."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    own = sets.join(ids, "id", "left_semi")
    side = lambda s: own.select(F.col("id").alias(s), F.col("grams").alias(f"{s}_grams"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_grams", "b_grams")
    return both.mapInArrow(partial(_verified, percent=percent), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, name: str = "jaccard") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included) of every document."""
    spark = docs.sparkSession
    store = Store(spark, name)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    chosen = one_text_each(texts, store)
    signed_keys = store.write(chosen.mapInArrow(partial(_signatures, n=n, percent=percent), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"), "signatures")
    signed = store.write(signed_keys.drop("keys"), "sizes")
    # Equal sets: links without further ado.  Only the smallest id of equal sets is compared with others.
    equal = signed.filter("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    copies = store.write(signed.filter("n_shingles > 0").select("doc_id", "n_shingles", "f1", "f2").distinct().join(equal, ["n_shingles", "f1", "f2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("id"), "rep"), "copies")
    runs = key_runs(signed_keys.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id")), store)
    # Every row of a key that two rows have is a member once; copies are left out, as their sets are compared already.
    members = runs.select("key", "id").distinct().join(copies.select("id"), "id", "left_anti")
    members = store.write(members, "members")
    store.settle()
    ids = store.write(members.select("id").distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = store.write(chosen.join(few, chosen.doc_id == ids.id, "left_semi").dropDuplicates(["doc_id"]).mapInArrow(partial(_sets, n=n), "id long, n long, grams array<long>, sketch array<long>"), "sets")
    store.free(signed_keys)
    store.settle()
    sketches = sets.select("id", F.col("n").alias("size"), "sketch")
    verify = lambda pairs: links_among(pairs, sets, percent)
    limit = (partial(smallest_partner, percent=percent), lambda low, high: most_different(low + high, percent))
    rows_of = lambda ids: (members if ids is None else members.join(ids, "id", "left_semi")).join(sketches, "id").select("key", "id", "size", "sketch")
    groups = link_buckets([rows_of], limit, verify, store, nearest=NEAREST)
    labels = extended(groups, copies.select(F.col("rep").alias("a"), F.col("id").alias("b")), store)
    store.keep_only(signed, labels)
    if chosen is not texts:  # each row of a repeated id gets what its chosen text has
        signed = texts.select("doc_id").join(signed.select("doc_id", "n_shingles").distinct(), "doc_id")
    return signed.select("doc_id", "n_shingles").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, components_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that stand for their group: the smallest id of each, and every document of null id."""
    gone = components_.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
