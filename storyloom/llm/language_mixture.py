"""Language identification as inference of a mixture.

Model: P(character | the three characters before it, language), interpolated from the orders 1 to 4
with weights that grow with a context's count (Witten-Bell), counted in Spark on labelled texts.  A
word's likelihood in a language is the product over its characters, word ends included.

Document: each word comes from one language; the languages' proportions are unknown.
Expectation-maximisation estimates the proportions from the words' likelihoods.  The language set
is selected greedily by penalised likelihood: start from the best single language and add the one that
raises ``log L - penalty * log(words) / 2 * |set|`` most, until none does.  The prediction is
the language of the largest proportion, the score that proportion.

Learning uses at most ``sample_chars`` characters of labelled text for each language, taken by the hash of
the text, whole texts at a time (a documented bound for fitting a classifier); every text is predicted.

Rows: a null text, or one without a letter, is ``und`` with score 0.  Ties go to the smaller language code.
Without labelled texts every text is ``und``.  Only letters and apostrophes take part; digits, other numbers and marks end words.
A labelled text without an id is learnt from like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .shared_store import Store, bounded_batches, release_memory

ORDER = 4
#: Characters of labelled text that each language's model is fitted on, at most.
SAMPLE_CHARS = 1_500_000
#: n-grams kept in a model: those seen at least so often.
MIN_COUNT = 2
#: Rounds of expectation-maximisation, and the change of log-likelihood a word below which it stops.
ROUNDS, SETTLED = 30, 1e-4
#: Weight of the penalty on each further language.
PENALTY = 4.0
#: Words in a worker's memory of word likelihoods.
MEMORY = 60_000
_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> Counter:
    """Lower-case words of letters, counted.  What the pattern takes for parts of words but is a number (a fraction, a Roman numeral) ends a word."""
    found = Counter(_WORD.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, text -> lang, gram, n: the n-grams of orders 1 to ORDER within padded words."""
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            words: Counter = Counter()
            for text in group["text"]:
                words.update(letter_words(text))
            total: dict[str, int] = {}
            for w, c in words.items():
                s = " " * (ORDER - 1) + w + " "
                for i in range(ORDER - 1, len(s)):
                    for n in range(1, ORDER + 1):
                        g = s[i - n + 1 : i + 1]
                        total[g] = total.get(g, 0) + int(c)
            if total:
                yield pd.DataFrame({"lang": lang, "gram": list(total), "n": list(total.values())})


class LanguageModel:
    """Character models of several languages; small enough to send to every executor."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique().tolist())
        at = {x: k for k, x in enumerate(self.langs)}
        n = len(self.langs)
        table: dict[str, np.ndarray] = {}
        for lang, gram, c in zip(counts["lang"], counts["gram"], counts["n"]):
            row = table.get(gram)
            if row is None:
                row = table[gram] = np.zeros(n)
            row[at[lang]] = c
        follow: dict[str, np.ndarray] = {}
        kinds: dict[str, np.ndarray] = {}
        for gram, row in table.items():
            head = gram[:-1]
            if head not in follow:
                follow[head], kinds[head] = np.zeros(n), np.zeros(n)
            follow[head] += row
            kinds[head] += row > 0
        letters = sum(len(g) == 1 for g in table) + 1
        prob: dict[str, np.ndarray] = {}
        self.floor = np.full(n, 1.0 / letters)
        for gram in sorted(table, key=len):
            head = gram[:-1]
            share = kinds[head] / np.maximum(follow[head] + kinds[head], 1)
            share = np.where(follow[head] > 0, share, 1.0)
            lower = prob.get(gram[1:], self.floor) if len(gram) > 1 else self.floor
            prob[gram] = np.where(follow[head] > 0, table[gram] / np.maximum(follow[head] + kinds[head], 1), 0) + share * lower
        # One matrix for all that a character can add: an n-gram's log-probability, a context's back-off weight, the floor.
        self.gram = {g: k for k, g in enumerate(prob)}
        self.head = {h: k for k, h in enumerate(follow, len(prob))}
        self.none = len(prob) + len(follow)
        rows = [np.log(p) for p in prob.values()]
        rows += [np.log(np.where(follow[h] > 0, kinds[h] / np.maximum(follow[h] + kinds[h], 1), 1.0)) for h in follow]
        no_context = rows[self.head[""]] if "" in self.head else np.zeros(n)
        self.matrix = np.array([*rows, np.log(self.floor) + no_context])
        del self.floor

    def parts(self, w: str) -> list[int]:
        """Rows of the matrix that add up to a word's log-likelihood in each language."""
        s = " " * (ORDER - 1) + w + " "
        gram, head, out = self.gram, self.head, []
        for i in range(ORDER - 1, len(s)):
            for k in range(i - ORDER + 1, i + 1):
                found = gram.get(s[k : i + 1])
                if found is not None:
                    out.append(found)
                    break
                if k < i and (b := head.get(s[k:i])) is not None:
                    out.append(b)
            else:
                out.append(self.none)
        return out

    def words(self, found: list[str]) -> np.ndarray:
        """Log-likelihoods of words in each language."""
        parts = [self.parts(w) for w in found]
        sizes = np.array([len(p) for p in parts])
        return np.add.reduceat(self.matrix[np.array([x for p in parts for x in p])], np.cumsum(sizes) - sizes, axis=0)


def mixture(like: np.ndarray, counts: np.ndarray, doc: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of many documents at once.

    like: words x languages, scaled so that the best is 1; counts and doc: of each word; first: a document's first word;
    allowed: documents x languages, the set that each may use.
    """
    theta = allowed / allowed.sum(1, keepdims=True)
    n = np.add.reduceat(counts, first)
    old = np.full(len(first), -np.inf)
    for _ in range(ROUNDS):
        p = like * theta[doc]
        s = p.sum(1)
        ll = np.add.reduceat(counts * np.log(np.maximum(s, 1e-300)), first)
        if np.all(ll - old <= SETTLED * n):
            break
        old = ll
        theta = np.add.reduceat(p * (counts / np.maximum(s, 1e-300))[:, None], first, axis=0) / n[:, None]
    return theta, ll


def select_set(like: np.ndarray, counts: np.ndarray, doc: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, size of the set) after greedy growth by penalised likelihood."""
    n_docs, n_langs = len(first), like.shape[1]
    single = np.add.reduceat(counts[:, None] * np.log(np.maximum(like, 1e-300)), first, axis=0)
    best = single.argmax(1)
    theta = np.zeros((n_docs, n_langs))
    theta[np.arange(n_docs), best] = 1
    ll = single[np.arange(n_docs), best]
    size = np.ones(n_docs, int)
    cost = penalty * np.log(np.maximum(np.add.reduceat(counts, first), 2)) / 2
    # The likelihood of any set is at most that of the words' best languages: who cannot gain is left alone.
    most = np.add.reduceat(counts * np.log(np.maximum(like.max(1), 1e-300)), first)
    ends = np.append(first[1:], len(doc))
    open_ = np.flatnonzero(most - ll > cost)
    while len(open_):
        rows = np.concatenate([np.arange(first[k], ends[k]) for k in open_])
        lengths = ends[open_] - first[open_]
        f = np.cumsum(lengths) - lengths
        d = np.repeat(np.arange(len(open_)), lengths)
        gain, new_theta, new_ll = np.zeros(len(open_)), theta[open_].copy(), ll[open_].copy()
        for k in range(n_langs):
            allowed = (theta[open_] > 0).astype(float)
            fresh = allowed[:, k] == 0
            allowed[:, k] = 1
            t, l = mixture(like[rows], counts[rows], d, f, allowed)
            g = np.where(fresh, l - ll[open_] - cost[open_], 0)
            better = g > gain
            gain[better], new_theta[better], new_ll[better] = g[better], t[better], l[better]
        up = gain > 0
        theta[open_[up]], ll[open_[up]] = new_theta[up], new_ll[up]
        size[open_[up]] += 1
        open_ = open_[up]
        open_ = open_[size[open_] < n_langs]
    return theta, size


def _predict(batches: Iterator[pd.DataFrame], model, penalty: float, give_text: bool) -> Iterator[pd.DataFrame]:
    m: LanguageModel = model.value
    known: dict[str, int] = {}
    rows = np.zeros((1024, max(1, len(m.langs))), np.float32)
    names = np.array([*m.langs, "und"], dtype=object)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            pred, score, spoken = np.full(len(part), len(m.langs)), np.zeros(len(part)), [[] for _ in range(len(part))]
            idx, cnt, doc = [], [], []
            if len(known) > MEMORY:
                known.clear()
            fresh, used = [], len(known)
            for k, text in enumerate(part["text"]):
                if text is None or not m.langs:
                    continue
                own = letter_words(text)
                at_ = []
                for w in own:
                    j = known.get(w)
                    if j is None:
                        j = known[w] = len(known)
                        fresh.append(w)
                    at_.append(j)
                if own:
                    idx.extend(at_), cnt.extend(own.values()), doc.append((k, len(own)))
            if fresh:
                while used + len(fresh) > len(rows):
                    rows = np.concatenate([rows, np.zeros_like(rows)])
                rows[used : used + len(fresh)] = m.words(fresh)
            if doc:
                lengths = np.array([x[1] for x in doc])
                first = np.cumsum(lengths) - lengths
                logs = rows[np.array(idx)].astype(float)
                like = np.exp(logs - logs.max(1, keepdims=True))
                theta, _ = select_set(like, np.array(cnt, float), np.repeat(np.arange(len(doc)), lengths), first, penalty)
                who = np.array([x[0] for x in doc])
                pred[who], score[who] = theta.argmax(1), np.minimum(theta.max(1), 1.0)
                for k, t in zip(who, theta):
                    spoken[k] = [m.langs[j] for j in np.argsort(-t, kind="stable") if t[j] > 0]
            yield pd.DataFrame({**{c: part[c].to_numpy() for c in part.columns if give_text or c != "text"}, "lang_pred": names[pred], "score": score, "langs": spoken})
    del known, rows
    release_memory()


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """labelled: text, lang -> a model.  Takes each language's distinct texts in the order of their hash until the bound is reached, and their copies as far as there is room."""
    store = Store(labelled.sparkSession, "languages")
    texts = labelled.filter("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("c"))
    texts = texts.withColumn("slot", F.pmod("h", F.lit(1_000_003)))
    # The last slot that is taken, at least each language's first: at most a row for each slot of a language is ordered.
    slots = texts.groupBy("lang", "slot", "h").agg(F.max("c").alias("c"), F.sum("c").alias("all")).groupBy("lang", "slot").agg(F.sum("c").alias("c"), F.sum("all").alias("all"))
    before = F.sum("c").over(Window.partitionBy("lang").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    taken = F.col("before") < max(sample_chars, 1)
    last = slots.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("lang").agg(F.max(F.when(taken, F.col("slot"))).alias("last"), F.sum(F.when(taken, F.col("c"))).alias("c"), F.sum("all").alias("all"))
    room = F.when(F.col("all") <= sample_chars, F.lit(2**31 - 1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(float(sample_chars)) / F.greatest("c", F.lit(1))))).cast("int")
    last = last.select("lang", "last", room.alias("room"))
    last = store.write(last, "last")
    last = F.broadcast(last) if last.count() <= 10_000 else last  # one row for each language
    picked = texts.join(last, "lang").filter(F.col("slot") <= F.col("last")).groupBy("lang", "h").agg(F.first("text").alias("text"), F.least(F.count("*"), F.first("room")).cast("int").alias("times"))
    picked = picked.select("lang", "text", F.explode(F.sequence(F.lit(1), "times")))
    counts = picked.select("lang", "text").mapInPandas(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    return LanguageModel(counts.toPandas())


def identify(docs: DataFrame, labelled: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", penalty: float = PENALTY, sample_chars: int = SAMPLE_CHARS, give_text: bool = False) -> DataFrame:
    """keep columns (and text, if asked for), lang_pred, score, langs (the selected set, largest proportion first) of every document."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled, sample_chars))
    kept = docs.select(*keep, F.col(text_col).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if give_text or f.name != "text")
    return kept.mapInPandas(partial(_predict, model=model, penalty=penalty, give_text=give_text), f"{fields}, lang_pred string, score double, langs array<string>")


def keep_identified(docs: DataFrame, labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which some language is found, columns as before.

    Rejected: texts that are ``und``.  The mark is added beside the row's own columns in the same pass over
    the texts, so nothing is joined or shuffled; extra columns of any name and type stay as they are.
    """
    whole = docs.select(F.struct(F.lit(1).alias("__one"), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__row"), F.col(text_col).alias("text"))
    told = identify(whole, labelled, keep=("__row",), give_text=True).filter("lang_pred <> 'und'")
    return told.select(*[(F.col("text") if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns])
