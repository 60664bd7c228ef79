"""Lattice scores against all segmentations written out, and the base and the model against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from estrado.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["the", "a", "onheononinndor", "schöß", "1,234.50", "日本𐍈語", "x" * 30, "<0x0a>", "ab▁c", "▁", "é́"]


def segmentations(s, p):
    if not s:
        yield ()
    for z in range(1, len(s) + 1):
        if s[:z] in p.at:
            head = (p.at[s[:z]],)
        elif z == 1:
            head = tuple(p.byte[b] for b in s[0].encode())
        else:
            continue
        for tail in segmentations(s[z:], p):
            yield head + tail


@pytest.mark.parametrize("word", [w for w in WORDS if len(w) < 15])
def test_all_segmentations(word):
    p = lattice.pieces(PATH)
    w = p.initial
    every = list(segmentations(lattice.START + word, p))
    want = math.fsum(math.exp(sum(w[i] for i in s)) for s in every)
    assert math.exp(lattice.forward(word, p, w.tolist())) == pytest.approx(want, rel=1e-9)
    count, got = np.zeros(len(w)), np.zeros(len(w))
    for s in every:
        for i in s:
            count[i] += math.exp(sum(w[j] for j in s)) / want
    lattice.expected(word, p, w.tolist(), got)
    assert np.allclose(count, got)


def test_words_side_by_side(monkeypatch):
    """Arrays of words give what each word gives alone, in parts and beyond LONG too."""
    p = lattice.pieces(PATH)
    monkeypatch.setattr(lattice, "TOGETHER", 25)
    monkeypatch.setattr(lattice, "LONG", 20)
    assert np.allclose(lattice.spelled(WORDS, p, p.initial), [lattice.forward(w, p, p.initial.tolist()) for w in WORDS])
    a, b = np.zeros(len(p.initial)), np.zeros(len(p.initial))
    lattice.needed(WORDS, p, p.initial, a)
    for w in WORDS:
        lattice.expected(w, p, p.initial.tolist(), b)
    assert np.allclose(a, b)


def test_every_piece_is_found():
    p = lattice.pieces(PATH)
    for piece, i in list(p.at.items())[::37]:
        code = np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(np.uint64)
        assert p.find(p.keys(code)[len(piece) - 1])[0] == i


def plain(rows, rounds=lattice.ROUNDS):
    """By the definitions, a word at a time."""
    words = [(x or "").encode().lower().split() for _, x in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    c = Counter(w for ws, t in zip(words, train) if t for w in ws)
    types, ends = len(c), sum(train)
    n, v = sum(c.values()) + ends, types + (ends > 0)
    n1, n2 = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    p = lattice.pieces(PATH)
    w = p.initial.tolist()
    for _ in range(rounds):
        e = np.full(len(w), 0.1)
        for x in c:
            lattice.expected(x.decode(), p, w, e)
        w = np.log(e / e.sum()).tolist()
    prob = {x: (max(c[x] - d, 0) if c[x] else 0) / (n + 1) + (d * types + 0.5) / (n + 1) * math.exp(lattice.forward(x.decode(), p, w)) for ws in words for x in ws}
    base = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    return [
        (i, not t, len(ws) + 1, sum(c[x] > 0 for x in ws) + (ends > 0), n, sum(base(c[x]) for x in ws) + base(ends), sum(math.log10(prob[x]) for x in ws) + math.log10((ends + 0.5) / (n + 1)))
        for (i, _), t, ws in zip(rows, train, words)
    ]


def same(got, want):
    key = lambda r: str((r[0], *r[2:4], round(r[5], 6)))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
LONG = "Palabra larga " * 5000 + "x" * 3000
CASES = {
    "none": [],
    "empty": [(1, None), (2, ""), (None, " \t\n\x0b"), (4, "\x85 \xa0")],
    "no training row": [(i, "Some words here") for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0],
    "repeated rows and ids": [(3, "same TEXT same")] * 30 + [(3, "other"), (None, "other ÄÖ"), (None, None)],
    "mixed": [(i, f"word{i % 7} The the thé {'rare%d' % i}") for i in range(60)] + [(5, LONG), (70, "日本 語")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("head", [0, 2, lattice.HEAD])
def test_against_the_definitions(spark, name, head):
    d = spark.createDataFrame([(i, x, 1) for i, x in CASES[name]], "doc_id long, text string, n_tokens int").repartition(3)
    got = lattice.score_texts(d.withColumn("train", lattice.trains(F.col("doc_id"))), PATH, head=head)
    assert got.columns == NAMES
    same(got.collect(), plain(CASES[name]))


def test_op13_on_the_smallest_table(spark, tiny):
    d = pd.read_parquet(f"{tiny}/documents.parquet")
    got = lattice.op13(spark, tiny).select(*NAMES).collect()
    same(got, plain(list(zip(d.doc_id.tolist(), d.text.tolist()))))
    # texts of the corpus are likelier than the same letters in another order
    held = [r for r in got if r.held_out]
    assert held and all(r.score < 0 for r in got)


def test_common_words_are_bounded(spark):
    s = spark.createDataFrame([(i + 1,) for i in range(1000)], "every long")
    above = lambda most: s.filter(lattice.size_class(F.col("every")) >= lattice.common(s, most)).count()
    assert 200 < above(300) <= 300 and above(0) == 0 and above(1000) == 1000
