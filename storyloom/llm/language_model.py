"""Language-model scoring by interpolated modified Kneser-Ney.

Order two: P(word | word before), interpolated with the continuation distribution, interpolated with a uniform one
over the V known tokens and one unknown.  Tokens are words (runs of bytes other than ASCII white space, A-Z lower-cased) and one
end of text; the first word's context is a start that is never predicted.

Counting, in Spark: each batch of texts is cut down to its distinct (context, token) pairs with counts, packed by bucket and
shuffled; a bucket's pairs are summed in one task.  A pair's bucket is a hash of context and token, so no bucket grows with one word.
The number of buckets follows the amount of text.  Nothing is left out: all pairs of all training texts are counted and stored.

Stored: for each bucket the sorted 32-bit hashes of its pairs and their counts; for each word bucket the sorted 48-bit hashes of
words with count, continuation probability, back-off weight and context total.  Workers map the files in the shared folder into
memory, so all workers of a machine read the same pages; a shared folder that is no mounted path is copied to a
temporary folder of the worker first and removed at its end.  Pair hashes collide with a chance of about bucket size / 2**32.

Rows: a null or empty text is its end alone.  Without training texts, every token has the uniform probability 1.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import weakref
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared_store import Store
from .wordhash import U64, mix64, text_chunks, word_hashes

#: Characters of training text for one bucket of pairs.
BUCKET_CHARS = 5_000_000
#: Files that a worker keeps mapped.
MAPPED = 512
_MASK = U64((1 << 48) - 1)
#: Distinct pairs that a worker holds before it packs them.
FLUSH = 1_200_000
END, START = U64(1), U64(2)
_SIX = np.dtype([("lo", "<u4"), ("hi", "<u2")])


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, first token of each text): 48-bit hashes, the end included."""
    words, first = word_hashes(raw, offsets)
    words = (words & _MASK) | U64(4)  # never an END or START
    n = np.diff(first)
    at = np.cumsum(n + 1) - (n + 1)
    tokens = np.full(len(words) + len(n), END, U64)
    inside = np.ones(len(tokens), bool)
    inside[at + n] = False
    tokens[inside] = words
    context = np.empty(len(tokens), U64)
    context[1:] = tokens[:-1]
    context[at] = START
    return context, tokens, at


def _pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(context * U64(0x9E3779B97F4A7C15) + mix64(token))


def _bucket(pair: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(pair) >> U64(16)) % U64(buckets)).astype(np.int64)


def _six(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), _SIX)
    out["lo"], out["hi"] = x & U64(0xFFFFFFFF), x >> U64(32)
    return out


def _pack(context, token, count) -> bytes:
    big = np.flatnonzero(count > 255)
    return len(context).to_bytes(4, "little") + len(big).to_bytes(4, "little") + _six(context).tobytes() + _six(token).tobytes() + np.minimum(count, 255).astype(np.uint8).tobytes() + big.astype("<u4").tobytes() + count[big].astype("<u4").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    six = lambda at: (lambda x: x["lo"].astype(U64) | x["hi"].astype(U64) << U64(32))(np.frombuffer(blob, _SIX, n, at))
    count = np.frombuffer(blob, np.uint8, n, 8 + 12 * n).astype(np.int64)
    count[np.frombuffer(blob, "<u4", m, 8 + 13 * n)] = np.frombuffer(blob, "<u4", m, 8 + 13 * n + 4 * m)
    return six(8), six(8 + 6 * n), count


def _summed(context, token, count):
    """Distinct pairs with their counts, sorted by pair hash."""
    key = _pair(context, token)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
    return context[order][at], token[order][at], np.add.reduceat(count[order], at) if len(at) else count


def _partial_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """text -> bucket, pairs (packed)."""
    held: list[tuple] = []
    size = 0

    def flush():
        c, t, n = _summed(*(np.concatenate(x) for x in zip(*held)))
        b = _bucket(_pair(c, t), buckets)
        order = np.lexsort((c, b))
        c, t, n, b = c[order], t[order], n[order], b[order]
        at = np.flatnonzero(np.diff(b, prepend=-1))
        packed = [_pack(c[x:y], t[x:y], n[x:y]) for x, y in zip(at, [*at[1:], len(b)])]
        return pa.RecordBatch.from_arrays([pa.array(b[at].astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "pairs"])

    for batch in batches:
        for _, _, raw, offsets in text_chunks(batch.column(0)):
            context, token, _ = _tokens(raw, offsets)
            held.append(_summed(context, token, np.ones(len(token), np.int64)))
            size += len(held[-1][0])
            if size > FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file: 8 bytes for the number of entries, then the arrays; complete or not there at all."""
    data = [len(arrays[0]).to_bytes(8, "little"), *[np.ascontiguousarray(a).tobytes() for a in arrays]]
    local = urlparse(folder)
    if local.scheme in ("", "file"):
        os.makedirs(local.path, exist_ok=True)
        part = f"{local.path}/.{name}.{os.getpid()}"
        with open(part, "wb") as f:
            f.writelines(data)
        os.replace(part, f"{local.path}/{name}")
        return
    system, root = _fs(folder)
    with system.open_output_stream(f"{root}/{name}") as f:
        for x in data:
            f.write(x)


def _sum_bucket(frame: pd.DataFrame, folder: str) -> pd.DataFrame:
    """All partial counts of one bucket: writes its pairs and returns what words and the whole model need of them."""
    bucket = int(frame["bucket"].iloc[0])
    context, token, count = _summed(*(np.concatenate(x) for x in zip(*map(_unpack, frame["pairs"]))))
    short = (_pair(context, token) & U64(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(short, kind="stable")
    sorted_counts = count[order]
    many = np.flatnonzero(sorted_counts >= 65535)  # two bytes hold nearly all counts; the others stand in full in a file of their own
    _write(folder, f"pairs-{bucket}", [short[order], np.minimum(sorted_counts, 65535).astype(np.uint16)])
    if len(many):
        _write(folder, f"many-{bucket}", [many.astype(np.int64), sorted_counts[many]])
    words, inverse = np.unique(np.concatenate([context, token]), return_inverse=True)
    c, t = inverse[: len(context)], inverse[len(context) :]
    tally = lambda i, w: np.bincount(i, weights=w, minlength=len(words)).astype(np.int64)
    out = {
        "word": words.view(np.int64), "count": tally(t, count), "kinds": tally(t, np.ones(len(t))), "total": tally(c, count),
        "n1": tally(c, count == 1), "n2": tally(c, count == 2), "n3": tally(c, count > 2), "n4": np.zeros(len(words), np.int64),
    }
    whole = {"word": [-1 - bucket], "count": [0], "kinds": [0], "total": [0]} | {f"n{k}": [int((count == k).sum())] for k in (1, 2, 3, 4)}
    return pd.concat([pd.DataFrame(out), pd.DataFrame(whole)])


_WORD_ROWS = "word long, count long, kinds long, total long, n1 long, n2 long, n3 long, n4 long"


def discounts(n: list[float]) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) of Chen and Goodman from the counts of counts n1 to n4; 0.5, 1, 1.5 where they are not defined."""
    usual = np.array([0.0, 0.5, 1.0, 1.5])
    n1, n2, n3, n4 = n
    if min(n1, n2, n3, n4) <= 0:
        return usual
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((d >= 0) & (d <= [0, 1, 2, 3]), d, usual)


def _word_bucket(frame: pd.DataFrame, folder: str, model: dict) -> pd.DataFrame:
    """A bucket of words: writes hash, count, lower-order probability, back-off weight and context total."""
    frame = frame.sort_values("word")
    d1, d2 = np.array(model["lower"]), np.array(model["upper"])
    kinds, total = frame["kinds"].to_numpy(float), frame["total"].to_numpy(float)
    lower = np.maximum(kinds - d1[np.minimum(kinds, 3).astype(int)], 0) / max(model["pairs"], 1) + model["uniform"]
    weight = (d2[1] * frame["n1"] + d2[2] * frame["n2"] + d2[3] * frame["n3"]).to_numpy(float) / np.maximum(total, 1)
    arrays = [frame["word"].to_numpy(np.int64).astype(np.uint64), frame["count"].to_numpy(np.int64), lower.astype(np.float64), np.where(total > 0, weight, 1.0).astype(np.float32), total.astype(np.float32)]
    _write(folder, f"words-{int(frame['slot'].iloc[0])}", arrays)
    return pd.DataFrame({"slot": [int(frame["slot"].iloc[0])], "n": [len(frame)]})


class KneserNey:
    """The model as a worker sees it: files mapped into memory when first needed."""

    def __init__(self, folder: str, model: dict):
        self.folder, self.model = folder, model
        self.maps: dict[str, list[np.ndarray]] = {}
        self.copies = None

    def _file(self, name: str, kinds: list) -> list[np.ndarray]:
        if name not in self.maps:
            while len(self.maps) >= MAPPED:  # the one that was mapped first goes
                gone = next(iter(self.maps))
                del self.maps[gone]
                if self.copies is not None:
                    os.remove(f"{self.copies}/{gone}")
            place = urlparse(self.folder)
            path = f"{place.path}/{name}"
            if place.scheme not in ("", "file"):
                if self.copies is None:
                    self.copies = tempfile.mkdtemp()
                    weakref.finalize(self, shutil.rmtree, self.copies, True)
                system, root = _fs(self.folder)
                path = f"{self.copies}/{name}"
                with system.open_input_stream(f"{root}/{name}") as a, open(path, "wb") as b:
                    shutil.copyfileobj(a, b)
            with open(path, "rb") as f:
                n = int.from_bytes(f.read(8), "little")
            at, out = 8, []
            for kind in kinds:
                out.append(np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
                at += n * np.dtype(kind).itemsize
            self.maps[name] = out
        return self.maps[name]

    def words(self, sorted_words: np.ndarray) -> tuple[np.ndarray, ...]:
        """(count, lower-order probability, back-off weight, context total) of distinct words in ascending order."""
        n, slots = len(sorted_words), self.model["slots"]
        count, lower = np.zeros(n, np.int64), np.full(n, self.model["uniform"])
        weight, total = np.ones(n), np.zeros(n)
        slot = _slot(sorted_words, slots)
        for k in np.unique(slot):
            if k not in self.model["full"]:
                continue
            mine = np.flatnonzero(slot == k)
            h, c, p, w, t = self._file(f"words-{k}", [np.uint64, np.int64, np.float64, np.float32, np.float32])
            at = np.minimum(np.searchsorted(h, sorted_words[mine]), len(h) - 1)
            hit = h[at] == sorted_words[mine]
            mine, at = mine[hit], at[hit]
            count[mine], lower[mine], weight[mine], total[mine] = c[at], p[at], w[at], t[at]
        return count, lower, weight, total

    def pairs(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        out = np.zeros(len(context), np.int64)
        pair = _pair(context, token)
        bucket = _bucket(pair, self.model["buckets"])
        short = (pair & U64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((short, bucket))
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        full = self.model["pair_files"]  # a bit for each bucket that has pairs
        for x, y in zip(starts, [*starts[1:], len(order)]):
            mine = order[x:y]
            k = int(bucket[mine[0]])
            if not full[k >> 3] >> (k & 7) & 1:
                continue
            h, c = self._file(f"pairs-{k}", [np.uint32, np.uint16])
            at = np.minimum(np.searchsorted(h, short[mine]), len(h) - 1)
            found = np.where(h[at] == short[mine], c[at], 0).astype(np.int64)
            if (found == 65535).any():
                place, whole = self._file(f"many-{k}", [np.int64, np.int64])
                big = found == 65535
                found[big] = whole[np.searchsorted(place, at[big])]
            out[mine] = found
        return out

    def log10_probs(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token."""
        words, inverse = np.unique(np.concatenate([context, token]), return_inverse=True)
        c, t = inverse[: len(context)], inverse[len(context) :]
        count, lower, weight, total = self.words(words)
        key = c.astype(np.int64) * len(words) + t
        pairs, back = np.unique(key, return_inverse=True)
        pc, pt = pairs // max(len(words), 1), pairs % max(len(words), 1)
        seen = np.flatnonzero((total[pc] > 0) & (count[pt] > 0))
        n = np.zeros(len(pairs), np.int64)
        n[seen] = self.pairs(words[pc[seen]], words[pt[seen]])
        d = np.array(self.model["upper"])
        p = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total[pc], 1) + weight[pc] * lower[pt]
        return np.log10(p)[back], count[t]


def _slot(words: np.ndarray, slots: int) -> np.ndarray:
    return ((words >> U64(8)) % U64(slots)).astype(np.int64)


def train(texts: DataFrame, store: Store, text_col: str = "text") -> KneserNey:
    """Counts all ``texts`` and writes the model into the shared folder."""
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars")).first()
    buckets = max(1, -(-size["chars"] // BUCKET_CHARS))
    folder = f"{store.root}/model"
    parts = texts.mapInArrow(partial(_partial_counts, buckets=buckets), "bucket int, pairs binary")
    rows = parts.groupBy("bucket").applyInPandas(partial(_sum_bucket, folder=folder), _WORD_ROWS)
    names = ["count", "kinds", "total", "n1", "n2", "n3", "n4"]
    words = store.write(rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]), "words")
    real = F.col("word") >= 0
    of = lambda k: F.sum(F.when(real & (F.col("kinds") == k), 1).otherwise(0))
    stats = words.agg(
        F.sum(F.when(real & (F.col("count") > 0), 1).otherwise(0)).alias("v"), F.sum(F.when(real, F.col("count"))).alias("n"), F.sum(F.when(real, F.col("kinds"))).alias("pairs"),
        *[of(k).alias(f"k{k}") for k in (1, 2, 3, 4)], *[F.sum(F.when(~real, F.col(f"n{k}"))).alias(f"n{k}") for k in (1, 2, 3, 4)], F.sum(F.when(real & (F.col("kinds") > 2), 1).otherwise(0)).alias("k3up"),
    ).first()
    v, tokens_n, pairs = (int(stats[c] or 0) for c in ("v", "n", "pairs"))
    lower = discounts([float(stats[f"k{k}"] or 0) for k in (1, 2, 3, 4)])
    upper = discounts([float(stats[f"n{k}"] or 0) for k in (1, 2, 3, 4)])
    left = (lower[1] * (stats["k1"] or 0) + lower[2] * (stats["k2"] or 0) + lower[3] * (stats["k3up"] or 0)) / pairs if pairs else 1.0
    slots = max(1, -(-v // 500_000))
    model = {"buckets": buckets, "slots": slots, "v": v, "n": tokens_n, "pairs": pairs, "lower": lower.tolist(), "upper": upper.tolist(), "uniform": left / (v + 1)}
    slot = F.pmod(F.shiftrightunsigned("word", 8), F.lit(slots)).cast("int")
    done = words.filter(real).withColumn("slot", slot).groupBy("slot").applyInPandas(partial(_word_bucket, folder=folder, model=model), "slot int, n long").collect()  # one row a slot
    model["full"] = {r["slot"] for r in done}
    # Buckets without a pair have no file.  A byte tells of eight buckets.
    some = words.filter("word < 0").selectExpr("-1 - word AS b").groupBy(F.expr("b div 8").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(b % 8 AS int)))").alias("bits")).toArrow()
    model["pair_files"] = np.zeros(buckets // 8 + 1, np.uint8)
    model["pair_files"][some["at"].to_numpy().astype(np.int64)] = some["bits"].to_numpy()
    store.free(words)
    return KneserNey(folder, model)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: KneserNey = model.value
    low = float(m.model["n"] + 1 * (m.model["v"] + 1))
    for batch in batches:
        keep = [batch.column(k) for k in range(batch.num_columns - 1)]
        for lo, hi, raw, offsets in text_chunks(batch.column(batch.num_columns - 1)):
            context, token, first = _tokens(raw, offsets)
            logs, count = m.log10_probs(context, token)
            base = np.log10((count + 1) / low)
            sizes = np.diff(first, append=len(token)).astype(np.int64)
            columns = [pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(hi - lo, m.model["n"], np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first))]
            yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in keep], *columns], names=[*batch.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep columns, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of ``docs``."""
    store = Store(docs.sparkSession, "kneser-ney")
    model = docs.sparkSession.sparkContext.broadcast(train(training, store, text_col))  # paths and numbers; the counts stay in the files
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "__text")
    scored = kept.mapInArrow(partial(_score, model=model), f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
