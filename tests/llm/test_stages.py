"""Each stage of the pipeline against a plain version of what it keeps."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from estrado.llm import langid, mixing, packing, tokens

from .test_brute import plain_targets
from .test_clashes import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def posterior(emit, transitions):
    """Mean posterior of each label over a chain, by forward and backward sums over the whole text."""
    n, T = len(emit), np.exp(transitions)
    a, b = np.zeros_like(emit), np.ones_like(emit)
    a[0] = T.sum(axis=0) * emit[0]
    for i in range(1, n):
        a[i] = (a[i - 1] @ T) * emit[i]
        a[i] /= a[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = T @ (emit[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    p = a * b
    return (p / p.sum(axis=1, keepdims=True)).mean(axis=0)


def test_language_keeps_what_the_field_knows(spark, docs):
    more = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "1234 !! 56", "en", "s", 5), (90_003, "", None, None, None)], DOCS)
    d = docs.select(*corpus_pipeline.COLUMNS).unionByName(more)
    field = langid.fit(d.select("doc_id", "text", "lang"))
    want = set()
    for r in d.collect():
        words = [w for w in map(langid.clean, (r.text or "").split()) if w]
        if words and posterior(field.emissions(words), field.transitions).max() >= corpus_pipeline.LANGUAGE_SCORE:
            want.add(r.doc_id)
    got = corpus_pipeline.language(spark, d, "")
    assert got.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id for r in got.collect()} == want
    assert len(want) > 0.9 * docs.count() and not want & {90_001, 90_002, 90_003}


def test_repeated_passages_are_cut(spark, docs):
    d = docs.select(*corpus_pipeline.COLUMNS).collect()
    kept = brute([(r.doc_id, (r.text or "").encode()) for r in d], 50)
    want = {r.doc_id: (k.decode("utf-8", "ignore"), r.lang, r.source) for r, k in zip(d, kept)}
    got = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    assert {r.doc_id: (r.text, r.lang, r.source) for r in got} == want and len(got) == len(d)
    assert all(r.n_chars == len(r.text) for r in got)


def test_mix_repeats_rows_as_often_as_they_are_taken(spark, docs):
    got = corpus_pipeline.mix(spark, docs, "").toPandas()
    copies = {r.doc_id: r.copies for r in mixing.mix(docs.select(*corpus_pipeline.COLUMNS)).collect()}
    assert Counter(got.doc_id) == {i: n for i, n in copies.items() if n}
    d = docs.toPandas()
    words = lambda x: x.text.fillna("").map(lambda t: len(t.encode().split()))
    d["size"], got["size"] = words(d), words(got)
    for s, t in plain_targets(d.groupby("source")["size"].sum().to_dict()).items():
        g = got[got.source == s]
        assert abs(g["size"].sum() - t) <= max(d[d.source == s]["size"].max(), 0.02 * t)
    assert got.drop(columns="size").drop_duplicates().merge(d[["doc_id", "text"]], on=["doc_id", "text"]).shape[0] == got.doc_id.nunique()


def test_pack_fills_sequences(spark, docs):
    d = docs.union(docs.limit(3)).select(*corpus_pipeline.COLUMNS)  # some rows twice, as the mix leaves them
    got = corpus_pipeline.pack(spark, d, "").toPandas()
    t = tokens.words(tokens.default_path()).tokenizer
    size = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    times = Counter(r.doc_id for r in d.collect())
    for i, g in got.groupby("doc_id"):
        whole = [min(4096, size[i] - a) for a in range(0, size[i], 4096)]
        assert sorted(g.length) == sorted(whole * times[i])
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.CAPACITY
    # as few as best-fit decreasing over the same lengths takes
    rooms = []
    for n in sorted(got.length, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            k = min(fit, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(4096 - n)
    assert got.sequence_id.nunique() <= len(rooms)
