"""Voices joined by likeness against union-find."""

import numpy as np
import pandas as pd

from estrado.jobs.sequences import QUERIES
from estrado.operators import sequences


def union_find(ids, pairs):
    parent = {n: n for n in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in ids}


def all_pairs(ids, session, vec, least):
    s = vec @ vec.T > least
    return [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if s[i, j] and session[i] == session[j]]


def test_voice_components_meets_all_pairs_of_a_label(spark, tiny):
    e = pd.read_parquet(f"{tiny}/embeddings.parquet")
    vec = np.stack(e.embedding).astype(float)
    want = union_find(e.vec_id.tolist(), all_pairs(e.vec_id.tolist(), e.label.tolist(), vec, 0.15))
    got = QUERIES["voice_components"](spark, tiny).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_voice_links_across_blocks(spark):
    """Few links a voice, so that components are many, of all sizes, and cross the blocks."""
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(240, 8))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    ids, session = rng.permutation(10_000)[:240].tolist(), rng.integers(0, 3, 240).tolist()
    want = union_find(ids, all_pairs(ids, session, vec, 0.8))
    assert 3 < len(set(want.values())) < 230
    df = spark.createDataFrame([(s, i, v.tolist()) for s, i, v in zip(session, ids, vec)] + [(0, 10_001, None), (None, 10_002, vec[0].tolist())], "session int, id long, vec array<double>")
    links = sequences.voice_links(df, 0.8, block=16)
    got = {r.node: r.root for r in sequences.same_voice(links, df.select(df.id.alias("node"))).collect()}
    assert got == {**want, 10_001: 10_001, 10_002: 10_002}


def test_same_voice_joins_a_long_chain(spark):
    order = np.random.default_rng(1).permutation(400).tolist()
    pairs = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = sequences.same_voice(pairs, spark.range(401).withColumnRenamed("id", "node")).collect()
    assert {r.node: r.root for r in got} == {**dict.fromkeys(range(400), 0), 400: 400}
