"""Counts after random inserts, moves and prunes equal a recount."""

import math
import random

from pyspark.sql import functions as F

from storyloom.operators.incremental import Counts, counted, signed

SCHEMA = "id string, cluster_id string, text string"


def content(c: Counts):
    return [sorted(map(tuple, df.collect())) for df in (c.story_words.select("cluster_id", "word", "n"), c.words.select("word", "df"), c.stories.select("cluster_id", "size"))]


def test_random_commands(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(12)] + ["Name", "Place", "EU"]
    frame = lambda rows: spark.createDataFrame([(i, *v) for i, v in rows.items()], SCHEMA)
    state, counts = {}, Counts.none(spark.range(1))
    for step in range(3):
        before = dict(state)
        for k in range(12):
            state[f"a{step}-{k}"] = (rng.choice(["s1", "s2", "s3", f"s{step}-{k}", None]), rng.choice(["", None, " ".join(rng.choices(words, k=5))]))
        for i in rng.sample(sorted(before), min(6, len(before))):
            state[i] = (rng.choice(["s1", "s2", "new"]), state[i][1])  # moved
        for i in rng.sample(sorted(before), min(4, len(before))):
            state.pop(i, None)  # pruned
        changed = {i for i in before.keys() | state.keys() if before.get(i) != state.get(i)}
        part = lambda rows: frame({i: rows[i] for i in changed if i in rows})
        counts = counts.add(signed(part(before), part(state))).kept()
        assert content(counts) == content(counted(frame(state), F.col("text")))
    got = {r.word: round(r.idf, 9) for r in counts.idf_table().collect()}
    n = len({c for c, _, _ in content(counts)[0]})
    assert got and all(abs(v - (math.log((n + 1) / (d + 1)) + 1)) < 1e-8 for (w, d) in content(counts)[1] for v in [got[w]])
