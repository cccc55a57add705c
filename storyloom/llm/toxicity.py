"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text: its words (runs of ASCII letters and of characters above U+007F, lower-cased) and the prefixes of ``PREFIXES`` bytes
of longer words, each once, hashed to ``2 ** TERM_BITS`` places.  With m terms, the score is the logistic of
``w0 + sum w_i + sum_{i<j} <v_i, v_j> / sqrt(m)``, so pairs of terms (an insult with a group's name) count beyond their own weights, also
where neither term tells anything alone.

Learning uses all terms of about ``max_labelled`` labelled texts at most, picked by the hash of their id (a documented bound for fitting
a classifier); the texts are turned into places on the executors, and the driver gets those only.  Training is AdaGrad on the logistic
loss, at least ``STEPS`` steps; each step shrinks the weights of its terms (L1) and their factors (L2), so that terms that tell nothing
come to rest at zero.  A learnt shift and slope on the training texts (Platt) put the scores on the scale of probabilities.

Rows: a null or empty text has no terms and gets the base score.  Without labelled texts, or with one class alone, every score is the
share of the label (0.5 without any).  Ties cannot arise: a text's score depends on its terms only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared_store import bounded_batches, release_memory
from .wordhash import U64, hash_spans, list_array, mix64, text_chunks

PREFIXES = (4, 5, 6)
TERM_BITS = 18
MAX_LABELLED = 20_000
FACTORS = 8
#: Passes over the labelled texts, and the least number of steps of ``BATCH`` texts.
EPOCHS, STEPS, BATCH = 12, 2000, 64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def term_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the terms of each text, distinct and ascending; the number of each text's terms)."""
    texts, n = len(offsets) - 1, len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(texts, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = _LETTER[raw]
    begin = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    end = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
    owner = np.searchsorted(offsets, begin, side="right") - 1
    h = hash_spans(raw, begin, end)
    # Distinct words first: most words of a long text stand in it several times.
    _, first = np.unique(mix64(h + mix64(owner.astype(U64))), return_index=True)
    begin, end, owner, h = begin[first], end[first], owner[first], h[first]
    places, owners = [h >> U64(64 - TERM_BITS)], [owner]
    for size in PREFIXES:
        longer = np.flatnonzero(end - begin > size)
        places.append(mix64(hash_spans(raw, begin[longer], begin[longer] + size) + U64(size)) >> U64(64 - TERM_BITS))
        owners.append(owner[longer])
    both = np.unique(np.concatenate(owners).astype(np.int64) << TERM_BITS | np.concatenate(places).astype(np.int64))
    return both & (1 << TERM_BITS) - 1, np.bincount(both >> TERM_BITS, minlength=texts)


def _segment(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums by text; a text without terms has 0."""
    out = np.zeros((len(counts), *values.shape[1:]))
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


class FactorizationMachine:
    """Weights and factors by place."""

    def __init__(self, base: float, weights: np.ndarray, factors: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.base, self.weights, self.factors, self.slope, self.shift = base, weights, factors, slope, shift

    def parts(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sum of weights, sum over pairs of terms, factors of each term, their sums) of texts with so many terms each."""
        f = self.factors[places]
        s = _segment(f, counts)
        pairs = 0.5 * ((s**2).sum(1) - _segment((f**2).sum(1), counts)) / np.sqrt(np.maximum(counts, 1))
        return _segment(self.weights[places], counts), pairs, f, s

    def raw(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores before calibration, some hundred thousand terms (or one text) at a time."""
        out, ends, at = np.empty(len(counts)), np.cumsum(counts), 0
        while at < len(counts):
            begin = ends[at] - counts[at]
            to = max(at + 1, int(np.searchsorted(ends, begin + 200_000, side="right")))
            linear, pairs, _, _ = self.parts(places[begin : ends[to - 1]], counts[at:to])
            out[at:to] = self.base + linear + pairs
            at = to
        return out

    def prob(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -35, 35)))


def _labelled_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label, key -> key, label, terms."""
    for batch in batches:
        for lo, hi, raw, offsets in text_chunks(batch.column(0)):
            places, counts = term_places(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), list_array(places.astype(np.int32), counts)], names=["key", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> FactorizationMachine:
    """labels: id_col, label (0 or 1); one row for each labelled text.  Few enough are picked before the texts are joined, so no text is shuffled."""
    labels = labels.select(F.col(id_col).alias("__id"), F.col("label").cast("int").alias("label")).filter("__id is not null and label is not null")
    total = labels.count()
    if total > max_labelled:
        labels = labels.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < int(1_000_003 * max_labelled / total))
    texts = docs.select(F.col(id_col).alias("__id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    labelled = texts.join(F.broadcast(labels), "__id").select("text", "label", F.col("__id").cast("string").alias("key"))  # about max_labelled rows
    rows = labelled.mapInArrow(_labelled_places, "key string, label int, terms array<int>").toArrow().sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()
    places = 1 << TERM_BITS
    if not len(rows):
        return FactorizationMachine(0.0, np.zeros(places), np.zeros((places, factors)))
    terms = pa.concat_arrays(rows["terms"].chunks)
    return train(terms.flatten().to_numpy(), terms.value_lengths().to_numpy().astype(np.int64), rows["label"].to_numpy().astype(float), factors, epochs, seed)


def train(index: np.ndarray, counts: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> FactorizationMachine:
    """index: places of the terms of all texts, text by text; counts: of each text's terms; y: labels."""
    places = 1 << TERM_BITS
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    machine = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(places), np.zeros((places, factors)))
    if y.min() == y.max() or not len(index):
        return machine
    rng = np.random.default_rng(seed)
    w, v = machine.weights, rng.normal(0, 0.05, (places, factors))
    seen = np.zeros(places, bool)
    seen[index] = True
    v[~seen] = 0
    machine.factors, machine.base = v, 0.0
    begin = np.cumsum(counts) - counts
    # Each class weighs the same, as the rarer label is the one looked for; the calibration below undoes the shift.
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    gw, gv, gb = np.full(places, 1e-2), np.full((places, factors), 1e-2), 1e-2
    rate, factor_rate, l1, l2 = 0.2, 0.02, 1e-3, 1e-3
    for _ in range(max(epochs, -(-STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            batch = np.sort(order[at : at + BATCH])
            sizes = counts[batch]
            i = index[np.repeat(begin[batch] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            d = np.repeat(np.arange(len(batch)), sizes)
            linear, pairs, f, s = machine.parts(i, sizes)
            g = weight[batch] * (1 / (1 + np.exp(-np.clip(machine.base + linear + pairs, -35, 35))) - y[batch]) / len(batch)
            uniq, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, weights=g[d], minlength=len(uniq))
            per = (g / np.sqrt(np.maximum(sizes, 1)))[d][:, None] * (s[d] - f)
            dv = np.stack([np.bincount(inv, weights=per[:, k], minlength=len(uniq)) for k in range(factors)], 1) + l2 * v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            step = rate / np.sqrt(gw[uniq])
            moved = w[uniq] - step * dw
            w[uniq] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            v[uniq] -= factor_rate * dv / np.sqrt(gv[uniq])
            db = g.sum()
            gb += db**2
            machine.base -= rate * db / np.sqrt(gb)
    z = machine.raw(index, counts)
    # Platt's two numbers, by Newton steps on the training texts with his smoothed targets.
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    slope, shift = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -35, 35)))
        q = p * (1 - p) + 1e-9
        grad = np.array([((p - target) * z).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        hess = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        size = max(1.0, float(np.abs(step).max()) / 2)
        slope, shift = slope - step[0] / size, shift - step[1] / size
    if slope > 0:
        machine.slope, machine.shift = float(slope), float(shift)
    machine.weights, machine.factors = w.astype(np.float32), v.astype(np.float32)
    return machine


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: FactorizationMachine = model.value
    for batch in batches:
        last = batch.num_columns - 1
        for lo, hi, raw, offsets in text_chunks(batch.column(last)):
            score = m.prob(m.raw(*term_places(raw, offsets)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).slice(lo, hi - lo) for k in range(last)], pa.array(score.astype(float)), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"]
            )
    release_memory()


def score_texts(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", **options) -> DataFrame:
    """keep columns, score, predicted of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col, **options))
    kept = docs.select(*keep, F.lower(F.col(text_col).cast("string")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "__text")
    return kept.mapInArrow(partial(_score, model=model), f"{fields}, score double, predicted int")
