"""Operators on frames worked by hand, and properties of the folds."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estrado.functions import text as tx
from estrado.operators import alerts, resolve, sequences, turns, upserts, vectors
from estrado.sources import readers

SEG = "pleno_id int, seg_id int, start double, end double, speaker string, text string"


def seg(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SEG)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_overlap_assign(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 20.0, 22.0), (1, 2, 50.0, 52.0)], "pleno_id int, seg_id int, start double, end double")
    t = spark.createDataFrame([(1, 0.0, 4.0, "A"), (1, 3.0, 10.0, "B"), (1, 9.0, 10.0, "A"), (1, 20.0, 22.0, "C"), (1, 21.5, 22.0, "D")], "pleno_id int, start double, end double, speaker string")
    for bucket in (3600.0, 3.0):
        got = {r.seg_id: (r.speaker, r.solape_s, r.overlap) for r in turns.overlap_assign(s, t, bucket).collect()}
        assert got == {0: ("B", 7.0, True), 1: ("C", 2.0, False), 2: (None, None, False)}


def test_islands(spark):
    got = turns.turns(seg(spark, (0.0, 1.0, "A", "a"), (1.0, 2.0, "A", "b"), (2.0, 3.0, "B", "c"), (3.0, 4.0, "A", "d"))).orderBy("turno").collect()
    assert [(r.speaker, r.n, r.text, r.start, r.end) for r in got] == [("A", 2, "a b", 0, 2), ("B", 1, "c", 2, 3), ("A", 1, "d", 3, 4)]


def test_as_of(spark):
    s = seg(spark, *[(float(t), t + 1.0, "A", "") for t in (5, 10, 29, 30)])
    p = spark.createDataFrame([(1, 1, 10.0), (1, 2, None), (1, 3, 30.0)], "pleno_id int, punto int, at double")
    assert [r.punto for r in turns.as_of(s, p).orderBy("start").collect()] == [0, 1, 1, 3]


def test_gap_clusters(spark):
    x = spark.createDataFrame([(1, float(v)) for v in (0, 5, 19, 34)], "k int, x double")
    assert [r.cluster for r in turns.gap_clusters(x, "k", "x", 14).orderBy("x").collect()] == [0, 0, 0, 1]


def test_chunks_by_hand(spark):
    s = seg(spark, (0.0, 1.0, "A", "aaaa"), (1.0, 2.0, "A", "bbbb"), (2.0, 3.0, "A", "cc"), (3.0, 4.0, "B", "d"))
    assert [(r.text, r.speaker) for r in sequences.chunks(s, most=10).orderBy("idx").collect()] == [("aaaa bbbb", "A"), ("bbbb cc", "A"), ("d", "B")]


def test_debounce(spark):
    s = seg(spark, (0.0, 0.0, "", ""), (1.5, 0.0, "", ""), (3.0, 0.0, "", "")).select("pleno_id", "seg_id", "start")
    assert [r.start for r in sequences.debounced(s).orderBy("start").collect()] == [0.0, 3.0]


def test_handover_cooldown(spark):
    def turns_of(*said, valid=None):
        s = seg(spark, *[(float(i), 0.0, w, "") for i, w in enumerate(said)])
        return [r.turno for r in sequences.handovers(s, "call", valid).orderBy("seg_id").collect()]

    # before the first call, in a call and in its tail the chair speaks; turns are numbered from 0
    assert turns_of("x", "call", "call", "x", "call", "y", "i", "t") == [-1, -1, -1, 0, -1, 1, 1, 1]
    assert turns_of("call", "call", "call", "x") == [-1, -1, -1, 1]
    # a call that names nobody leaves the turn as it is, and has no tail
    assert turns_of("call", "x", "call?", "call", "y", valid=F.col("speaker") != "call?") == [-1, 0, 0, -1, 1]


def test_upsert(spark):
    old = spark.createDataFrame([("Ana", "PP", "Alcaldesa", 3, "csv"), ("Old", "X", "", 1, "csv")], "nombre string, grupo string, cargo string, n int, fuente string")
    new = spark.createDataFrame([("Ana", "", "X", 5, "ner"), ("New", "Y", "Z", 2, "ner")], old.schema)
    got = sorted(map(tuple, upserts.upsert(old, new, ["nombre"], replace=["n", "fuente"], fill=["grupo"]).collect()))
    assert got == [("Ana", "PP", "Alcaldesa", 5, "ner"), ("New", "Y", "Z", 2, "ner"), ("Old", "X", "", 1, "csv")]


def test_alerts_send_once(spark):
    subs = spark.createDataFrame([("a", "vivienda", "t1", 1), ("a", "empleo", "t2", 2), ("b", alerts.EVERYTHING, "t3", 3), ("c", "deportes", "t4", 4)], "email string, tema string, token string, pos int")
    found = spark.createDataFrame([(7, "vivienda", 1, 0.9), (7, "vivienda", 2, 0.8), (7, "empleo", 3, 0.7)], "pleno_id int, tema string, chunk int, sim double")
    m = alerts.matches(subs, found)
    assert {r.email: r.n for r in m.groupBy("email").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 3, "b": 2}
    assert {r.token for r in m.filter("email = 'a'").collect()} == {"t1"}
    sent = m.select("pleno_id", "email").distinct()
    assert upserts.not_yet(sent, sent, ["pleno_id", "email"]).count() == 0


def test_margin(spark):
    two = spark.createDataFrame([(i, "p", a, b) for i, (a, b) in enumerate([(0.62, 0.56), (0.60, 0.56), (0.54, 0.10), (0.60, 0.55)])], "qid int, persona string, s1 double, s2 double")
    assert [r.persona for r in vectors.with_margin(two, 0.55, 0.05).orderBy("qid").collect()] == ["p", None, None, None]


def test_axis(spark):
    axes = spark.createDataFrame([(0, [0.7071, 0.7071], [-0.70710678, 0.70710678], 0.0, 0.70710678)], "eje int, subject array<double>, direction array<double>, mid double, half double")
    rows = [(i, g, v) for g, v, n in (("r", [0.0, 1.0], 3), ("l", [1.0, 0.0], 3), ("few", [1.0, 0.0], 2)) for i in range(n)]
    got = {r.grupo: (r.score, r.confianza, r.n) for r in vectors.positions(spark.createDataFrame(rows, "id int, grupo string, vec array<double>"), axes).collect()}
    assert got == {"r": (1.0, "baja", 3), "l": (-1.0, "baja", 3), "few": (None, "sin_datos", 2)}


def test_cascade(spark):
    reg = spark.createDataFrame([("RUFIAN",), ("GARCIA",), ("GARCIAS",), ("DE LA TORRE",), ("MONTESINOS",)], "canon string")
    names = spark.createDataFrame([(n,) for n in ("RUFAAN", "GARCIA", "DELATORRE", "MONTES", "GARCI", "ZZ")], "name string")
    got = {r.name: (r.canon, r.via) for r in resolve.cascade(names, reg).collect()}
    assert got == {"RUFAAN": ("RUFIAN", 3), "GARCIA": ("GARCIA", 1), "DELATORRE": ("DE LA TORRE", 2), "MONTES": ("MONTESINOS", 4), "GARCI": ("GARCIA", 3), "ZZ": (None, None)}


@pytest.mark.parametrize(
    "said, want",
    [
        ("votos emitidos, 350; a favor, 170; en contra, 180; abstenciones, 0", [(350, 170, 180, 0)]),
        ("243 votos a favor más 2 votos telemáticos, 245; 77 en contra y 15 abstenciones", [(None, 245, 77, 15)]),
        ("nada", []),
    ],
)
def test_votes(spark, said, want):
    assert [(v.emitidos, v.a_favor, v.en_contra, v.abstenciones) for v in one(spark, tx.votes, said)] == want


def test_text_rules(spark):
    assert one(spark, tx.speaker_name, "Sánchez Pérez-Castejón (Candidato)") == "Sánchez Pérez-Castejón"
    assert one(spark, lambda c: tx.norm_key(tx.speaker_name(c)), "Sánchez Pérez-Castejón (Candidato)") == "sanchez perez-castejon"
    assert one(spark, tx.iso_date, "1 de marzo de 2016") == "2016-03-01" and one(spark, tx.iso_date, "foo") is None
    assert one(spark, tx.long_date, "27/01/2026") == "27 de enero de 2026" and one(spark, tx.long_date, "ayer") == "ayer"
    assert one(spark, tx.slug, "Ayuntamiento de Chiva") == "chiva"
    assert one(spark, lambda c: tx.clock(c.cast("double")), "3661") == "01:01:01"
    assert one(spark, tx.sentences, "Hola. ¿Qué? Así. no parte") == ["Hola.", "¿Qué?", "Así. no parte"]
    assert one(spark, tx.verdict, "¿Quién miente más?") == "opinion" and one(spark, tx.verdict, "¿Qué dijo Vox?") == "ok" and one(spark, tx.verdict, "receta de paella") == "off_topic"
    assert one(spark, tx.detect_party, "los del pp dicen") == "PP" and one(spark, tx.detect_party, "nadie") is None
    assert one(spark, tx.phonetic_key, "Vaca") == one(spark, tx.phonetic_key, "baka")
    assert one(spark, lambda c: tx.within_one_edit(c, F.lit("RUFIAN")), "RUFAAN") and not one(spark, lambda c: tx.within_one_edit(c, F.lit("BA")), "AB")


def test_alignment_and_edits():
    s = np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 0.9]])
    assert sequences.align(s, -0.3, 0.5) == [(0, 0), (1, 2)]
    assert sequences.word_edits("a b c".split(), "a x c d".split()) == 2
    assert sequences.similarity("Pedro de Sánchez", "pedro sanchez") > 0.8 and sequences.similarity("", "x") == 0


words = st.lists(st.sampled_from(list("abc")), max_size=8)


@given(words, words)
@settings(max_examples=60, deadline=None)
def test_word_edits_is_levenshtein(a, b):
    dp = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, dp[0] = dp[0], i
        for j, y in enumerate(b, 1):
            prev, dp[j] = dp[j], min(dp[j] + 1, dp[j - 1] + 1, prev + (x != y))
    assert sequences.word_edits(a, b) == dp[-1]


@given(st.lists(st.text("ab ", min_size=1, max_size=30), max_size=12), st.integers(5, 40))
@settings(max_examples=80, deadline=None)
def test_packs_are_short_and_whole(sentences, most):
    packs = sequences.packed_sentences(sentences, most)
    assert all(len(p) <= most for p in packs)
    whole = sequences.packed_sentences(sentences, most, carry=0)
    pieces = [x for s in sentences for x in ([s] if len(s) <= most else [s[i : i + most] for i in range(0, len(s), most)])]
    assert " ".join(whole) == " ".join(pieces)
    # two neighbours share at most one sentence
    assert sum(map(len, packs)) <= 2 * sum(len(p) + 1 for p in pieces)


@given(st.integers(1, 6), st.integers(1, 6), st.randoms())
@settings(max_examples=40, deadline=None)
def test_align_is_the_best(n, m, r):
    s = np.array([[round(r.random(), 2) for _ in range(m)] for _ in range(n)])

    def best(i, j):
        if i == 0 or j == 0:
            return -0.3 * (i + j)
        return max(best(i - 1, j - 1) + (s[i - 1, j - 1] if s[i - 1, j - 1] >= 0.5 else -9), best(i - 1, j) - 0.3, best(i, j - 1) - 0.3)

    got = sequences.align(s, -0.3, 0.5)
    assert sum(s[i, j] for i, j in got) - 0.3 * (n + m - 2 * len(got)) == pytest.approx(best(n, m))


def test_readers(spark, tmp_path):
    d = tmp_path / "sessions"
    d.mkdir()
    (d / "S-1.json").write_text(json.dumps({"id": " ", "legislatura": "XV", "interventions": [{"speaker": " Ana ", "text": "hola"}, {"speaker": "B", "party": "PP"}], "votaciones": [{"a_favor": 1, "en_contra": 2}]}), "utf-8")
    (d / "S-2.json").write_text("{not json", "utf-8")
    good, bad = readers.sessions(spark, str(d))
    assert [(r.pleno_id, r.legislatura, r.votaciones[0].a_favor) for r in good.collect()] == [("S-1", 0, 1)] and [r.file for r in bad.collect()] == ["S-2.json"]
    iv = readers.interventions(good)
    assert [(r.idx, r.speaker, r.party, r.text) for r in iv.orderBy("idx").collect()] == [(0, "Ana", "", "hola"), (1, "B", "PP", "")]
    readers.write_sessions(iv, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back.n_intervenciones == 2 and back.interventions[1].speaker == "B"
    (tmp_path / "r.csv").write_text("﻿Nombre, GRUPO\nAna,PP\n,X\n", "utf-8")
    assert [tuple(r) for r in readers.roster(spark, str(tmp_path / "r.csv")).collect()] == [("Ana", "PP", "")]
    (tmp_path / "o.csv").write_text("speaker,legislatura,party_correcto\nÁna,12,A\nANA,12,B\nx,,\ny,,C\n", "utf-8")
    assert sorted((r.key, r.legislatura, r.sigla) for r in readers.overrides(spark, str(tmp_path / "o.csv")).collect()) == [("ANA", 12, "B"), ("Y", None, "C")]
    (tmp_path / "g.txt").write_text("# c\nIBI\n\nplusvalia = plusvalía\n[01:05] no\n", "utf-8")
    terms, aliases = readers.glossary(spark, str(tmp_path / "g.txt"))
    assert {r.term for r in terms.collect()} == {"IBI", "[01:05] no"} and [tuple(r) for r in aliases.collect()] == [("plusvalia", "plusvalía")]
    assert [tuple(r) for r in readers.gold(spark, str(tmp_path / "g.txt")).collect()] == [(65, "no")]
    (tmp_path / "v.json").write_text(json.dumps({"Ana": {"vecs": [[1, 2], [3, 4]], "n": 2, "party": "PP"}, "Old": {"vec": [5, 6]}}), "utf-8")
    assert sorted((r.persona, r.exemplar, r.vec) for r in readers.voiceprints(spark, str(tmp_path / "v.json")).collect()) == [("Ana", 0, [1, 2]), ("Ana", 1, [3, 4]), ("Old", 0, [5, 6])]
    (tmp_path / "reg.json").write_text(json.dumps({"12": {"Ána Ruiz": ["PP", "Ana Ruiz"]}}), "utf-8")
    assert [(r.legislatura, r.key, r.sigla, r.canon) for r in readers.registry(spark, str(tmp_path / "reg.json")).collect()] == [(12, "ANA RUIZ", "PP", "Ana Ruiz")]
    (tmp_path / "f.jsonl").write_text('{"q": "a", "util": true}\nbad\n{"q": "b", "util": false}\n', "utf-8")
    assert readers.feedback(spark, str(tmp_path / "f.jsonl")).count() == 2
    (tmp_path / "vv.json").write_text(json.dumps({"id": "V1", "punto": 3, "recuento": {"a_favor": 5, "en_contra": 0, "abstencion": 1}, "sin_voto": 6, "asientos_a_revisar": [1, 2]}), "utf-8")
    assert [tuple(r) for r in readers.vision_votes(spark, str(tmp_path / "vv.json")).collect()] == [("V1", 3, 5, 0, 1, 6, 2)]
