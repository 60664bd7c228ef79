"""The pipeline's near-duplicates against all pairs of shingle sets."""

import numpy as np
import pandas as pd

import corpus_pipeline
from estrado.llm import shingles


def grams(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept(texts):
    """Ids that stay, by union-find over all pairs; ids are places."""
    sets = [grams(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if (both := len(sets[i] & sets[j])) and both >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in range(len(sets)) if find(i) == i}


def stage(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}


def test_near_copies_with_edits_spread_over_the_text(spark, monkeypatch):
    """Pairs at 0.95, 0.90, 0.86 and 0.81 go, at 0.77 they stay; one large cloud of copies meets in blocks."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))

    def edited(w, k):
        w = list(w)
        for i in np.linspace(8, len(w) - 9, k).astype(int):
            w[i] = word()
        return " ".join(w)

    texts, planted = [], {k: [] for k in (1, 2, 3, 4, 5)}
    for k in planted:
        for _ in range(40):
            w = [word() for _ in range(200)]
            planted[k].append(len(texts) + 1)
            texts += [" ".join(w), edited(w, k)]
    cloud = [word() for _ in range(200)]
    first = len(texts)
    texts += [edited(cloud, 1) for _ in range(60)] + [None, "", "two words", "Two  words"]
    got = stage(spark, texts)
    gone = {k: sum(i not in got for i in ids) / len(ids) for k, ids in planted.items()}
    print("recall by edits:", gone)
    assert gone[1] == gone[2] == gone[3] == 1 and gone[4] >= 0.97 and gone[5] == 0
    assert {i for i in got if i >= first} == {first, first + 60, first + 62}


def test_stage_keeps_what_all_pairs_keep(spark, tiny):
    texts = pd.read_parquet(f"{tiny}/documents.parquet").text.tolist()
    assert stage(spark, texts) == kept(texts)
