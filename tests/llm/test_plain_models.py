"""The factorization machine and the mixture of languages against plain versions that loop over pairs and words."""

import math
import random

import numpy as np

from storyloom.llm import language_mixture as L, toxicity as T


def test_machine_scores():
    """Scores of texts, an empty one and one of a single term among them, are the sums over terms and over all pairs of terms."""
    rng = np.random.default_rng(4)
    m = T.FactorizationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 3)), 1.7, -0.2)
    texts = [sorted(rng.choice(50, n, replace=False).tolist()) for n in (6, 0, 1, 20, 2)]
    got = m.prob(m.raw(np.array(sum(texts, [])), np.array([len(t) for t in texts])))
    for terms, p in zip(texts, got):
        pairs = sum(float(m.factors[a] @ m.factors[b]) for a in terms for b in terms if a < b)
        raw = 0.3 + sum(float(m.weights[a]) for a in terms) + pairs / math.sqrt(max(1, len(terms)))
        assert abs(p - 1 / (1 + math.exp(-(1.7 * raw - 0.2)))) < 1e-9


def plain_mixture(like, counts, langs):
    """Proportions and log likelihood of one document by expectation-maximisation over some languages."""
    theta = {k: 1 / len(langs) for k in langs}
    for _ in range(3000):
        share = [[theta[k] * row[k] for k in langs] for row in like]
        theta = {k: sum(c * s[j] / sum(s) for c, s in zip(counts, share)) / sum(counts) for j, k in enumerate(langs)}
    return theta, sum(c * math.log(sum(theta[k] * row[k] for k in langs)) for c, row in zip(counts, like))


def plain_set(like, counts, penalty):
    """Languages are added one by one, each time the one of the highest gain, while a gain exceeds its penalty."""
    n = len(like[0])
    best = max(range(n), key=lambda k: sum(c * math.log(row[k]) for c, row in zip(counts, like)))
    chosen = [best]
    theta, ll = plain_mixture(like, counts, chosen)
    cost = penalty * math.log(max(2, sum(counts))) / 2
    while len(chosen) < n:
        gains = []
        for k in range(n):
            if k not in chosen:
                t, new = plain_mixture(like, counts, [*chosen, k])
                gains.append((new - ll - cost, -k, t, new))
        gain, k, t, new = max(gains, key=lambda g: g[:2])
        if gain <= 0:
            break
        chosen, theta, ll = [*chosen, -k], t, new
    return theta


def test_sets_and_proportions():
    """Documents of one, two and three languages: the same sets, and proportions as near as the iteration's end allows."""
    rng = random.Random(8)
    docs = []
    for spoken in ([0], [1, 2], [0, 3], [0, 1, 2], [3]):
        rows = []
        for _ in range(25):
            home = rng.choice(spoken)
            row = [math.exp(-rng.uniform(3, 7)) for _ in range(4)]
            row[home] = 1.0
            rows.append(row)
        docs.append((rows, [rng.randrange(1, 4) for _ in rows]))
    like, counts = np.array(sum((d[0] for d in docs), [])), np.array(sum((d[1] for d in docs), []), float)
    lengths = np.array([len(d[0]) for d in docs])
    theta, size = L.select_set(like, counts, np.repeat(np.arange(len(docs)), lengths), np.cumsum(lengths) - lengths, L.PENALTY)
    seen = set()
    for (rows, n), got, k in zip(docs, theta, size):
        want = plain_set(rows, n, L.PENALTY)
        assert {j for j in range(4) if got[j] > 0} == set(want) and k == len(want)
        assert all(abs(got[j] - p) < 0.02 for j, p in want.items())
        seen.add(len(want))
    assert seen == {1, 2, 3}
