"""Rules of the record by values worked out by hand."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estrado import catalog
from estrado.functions import gazette as gz
from estrado.functions import record as rec
from estrado.functions import text as tx
from estrado.operators import fichas, lexicon, names, parties, resolve, sequences, upserts


def one(spark, f, *values):
    d = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r[0] for r in d.select(f(F.col("t"))).collect()]
    return got if len(got) > 1 else got[0]


def test_names_are_compared_without_marks_and_connectors():
    assert names.similarity("PÉREZ GIL", "Perez de la Gil") == 1.0
    assert names.similarity("El San", "el san") == 1.0 and names.similarity("de", "") == 0.0 and names.similarity(None, "x") == 0.0
    # each word of the first with its best of the second, however often
    assert names.similarity("Gil Gil", "Gil Marín") == 1.0 and names.similarity("Gil Marín", "Gil") == pytest.approx((1 + 2 / 8) / 2)


def test_compatibility_forms(spark):
    assert one(spark, rec.simple, "Artículo 1.º y 2ª nº 5", "ﬁn  ½ ＡＢ", "№ 3… ÇÑ", None) == ["articulo 1.o y 2a no 5", "fin 12 ab", "no 3... cn", ""]
    assert one(spark, rec.registry_name, "María-José O'Donnell Íñ. I Puig", "M.ª Gil") == ["MARIAJOSE ODONNELL IN PUIG", "MA GIL"]
    assert one(spark, rec.spoken_words, "El 1.º de 1.200 niños, ﬁn") == ["el", "1", "o", "de", "1200", "ninos", "fin"]


def test_slugs(spark):
    said = ["Ajuntament de València", "Concello de Lugo", "Ayuntamiento de la Pola", "Diputación de Cádiz", "Udala Bilbo", "Ajuntament d'Alacant", "Ayuntamiento del Ejido", "Concello", "  Ayuntamiento  de Chiva ", "¿?"]
    assert one(spark, tx.slug, *said) == ["valencia", "lugo", "pola", "diputacion-de-cadiz", "bilbo", "alacant", "ejido", "concello", "chiva", "entidad"]


def test_places_of_votes(spark):
    a, b = "a favor, 1; en contra, 2", "3 votos a favor, 4 en contra"
    text = f"x {a}. y {b}. z {a}."
    got = one(spark, tx.votes, text)
    assert [(v.pos, v.a_favor) for v in got] == [(text.index(a) + 1, 1), (text.index(b) + 1, 3), (text.rindex(a) + 1, 1)]


def test_sentences_in_three_ways(spark):
    assert one(spark, tx.sentences, "  Uno.\n\n Dos   tres.  ¿Y? ", " ", "a") == [["Uno.", "Dos tres.", "¿Y?"], [], ["a"]]
    assert one(spark, tx.statements, "Esta frase es larga, y bastante. Corta.\nOtra línea que también es larga sin punto\n\nx") == ["Esta frase es larga, y bastante.", "Otra línea que también es larga sin punto"]
    assert one(spark, tx.clauses, "Uno: dos; tres. cuatro?") == ["Uno:", "dos;", "tres.", "cuatro?"]
    assert one(spark, lambda c: tx.minutes(c.cast("double")), "3661.9", "5") == ["61:01", "0:05"]


def test_agenda_text(spark):
    two = "Orden del día:\n1. Primera cosa del orden\n2.- Segunda   cosa\n3. corta\nFdo.: x"
    assert one(spark, gz.agenda_text, two, "ORDEN DEL DÍA\n1. Una sola cosa larga\n2. no", "nada  de\nnada") == ["Primera cosa del orden\nSegunda cosa", "1. Una sola cosa larga 2. no", "nada de nada"]


def seg(spark, *texts):
    return spark.createDataFrame([(1, i, float(i), i + 0.5, t, "A") for i, t in enumerate(texts)], "pleno_id int, seg_id long, start double, end double, text string, speaker string")


def test_windows_count_the_spaces(spark):
    got = sequences.windows_of(seg(spark, "a" * 349, " ", "b" * 350, None, "c" * 10)).orderBy("idx").collect()
    assert [(r.idx, r.start, r.end, r.n, r.chars) for r in got] == [(0, 0.0, 2.5, 2, 700), (1, 4.0, 4.5, 1, 10)]
    assert got[1].text == "c" * 10 and sequences.windows_of(seg(spark, " ", None)).count() == 0


def test_packs_of_sentences():
    size = lambda x: [len(p) for p in sequences.packed_sentences(["s" * n for n in x], 1200)]
    # 700 + 499 and their spaces are 1201, and the one that is carried would not fit again
    assert size([700, 499]) == [700, 499] and size([700, 498]) == [1199]
    # a giant stands alone, and so does what follows
    assert size([2500, 50]) == [1200, 1200, 100, 50] and size([10, 1201, 10]) == [10, 1200, 1, 10]
    assert size([400, 400, 500, 600]) == [801, 901, 1101] and size([]) == []


@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 30)), max_size=30), st.integers(5, 40), st.integers(0, 2), st.booleans())
@settings(max_examples=60, deadline=None)
def test_chunks_hold_all_segments(rows, most, overlap, by_speaker):
    fold, out = sequences._Chunks(most, overlap, by_speaker), []
    for i, (who, n) in enumerate(rows):
        out += fold.row(float(i), i, i + 1.0, "x" * n, who)
    out += fold.end()
    said = [(i, who, n) for i, (who, n) in enumerate(rows) if n]
    # every segment stands in a chunk, chunks begin in order, and one of several segments is short enough
    starts = [c[2] for c in out]
    assert starts == sorted(starts) and {i for c in out for i in range(int(c[2]), int(c[3]))} >= {i for i, _, _ in said}
    for c in out:
        own = [x for x in said if c[2] <= x[0] < c[3]]
        assert len(c[1]) == sum(n for *_, n in own) + len(own) - 1 and (not by_speaker or len({w for _, w, _ in own}) == 1)


def test_folds_do_not_hang_on_batches(spark):
    s = seg(spark, *["w" * (i % 17) for i in range(200)]).union(seg(spark, *["v" * (i % 13) for i in range(150)]).withColumn("pleno_id", F.lit(2)))
    run = lambda: [sorted(map(tuple, f(s).collect())) for f in (lambda x: sequences.chunks(x, 40), lambda x: sequences.windows_of(x, 90), lambda x: sequences.handovers(x, "A"), lambda x: sequences.debounced(x, 3.0))]
    whole = run()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 7)
    try:
        assert run() == whole
    finally:
        spark.conf.unset(key)


@pytest.mark.parametrize("name,by_speaker,most", [("chunk_transcript", False, 1200), ("chunk_by_speaker", True, 30)])
def test_chunks_of_the_tables(spark, tiny, name, by_speaker, most):
    from estrado.jobs.sequences import spoken
    from estrado.sources.tables import segments

    rows, want = (segments if by_speaker else spoken)(spark, tiny).collect(), []
    for pleno in {r.pleno_id for r in rows}:
        now, idx = [], 0
        for r in sorted((r for r in rows if r.pleno_id == pleno and r.text.strip()), key=lambda r: (r.start, r.seg_id)):
            size = sum(len(x.text.strip()) + 1 for x in now)
            turned = by_speaker and now and r.speaker != now[0].speaker
            if now and (turned or size + len(r.text.strip()) + 1 > most):
                want.append((pleno, idx, " ".join(x.text.strip() for x in now), now[0].start, now[-1].end, now[0].speaker))
                idx, now = idx + 1, [] if turned else now[-1:]
            now = [*now, r]
        if now:
            want.append((pleno, idx, " ".join(x.text.strip() for x in now), now[0].start, now[-1].end, now[0].speaker))
    assert sorted(map(tuple, catalog.QUERIES[name](spark, tiny).collect())) == sorted(want)


def test_sentence_pack_of_the_tables(spark, tiny):
    import re

    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    got = {r.doc_id: (r.n, r.longest, r.chars) for r in catalog.QUERIES["sentence_pack"](spark, tiny).collect()}
    for d in docs:
        t = re.sub(r"[ \t\n\x0b\f\r]+", " ", d.text or "").strip(" ")
        parts, packs, now = [s for s in re.split(r"(?<=[.!?]) (?=[A-ZÁÉÍÓÚÑ¿¡(])", t) if s], [], []
        for s in parts:
            if len(s) > 1200:
                packs += ([now] if now else []) + [[s[i : i + 1200]] for i in range(0, len(s), 1200)]
                now = []
                continue
            if now and sum(len(x) + 1 for x in now) + len(s) + 1 > 1200:
                packs.append(now)
                now = now[-1:] if len(now[-1]) + len(s) + 2 <= 1200 else []
            now = [*now, s]
        sizes = [len(" ".join(p)) for p in packs + ([now] if now else [])]
        assert got[d.doc_id] == (len(sizes), max(sizes, default=0), sum(sizes)), d.doc_id


def test_sessions_by_number(spark):
    s = spark.createDataFrame([("DSCD-15-PL-7", 15), ("DSCD-14-PL-7", 15), ("X-14-PL-8", 14), ("X-15-PL-8", 15), ("Y-PL-9", 13)], "pleno_id string, legislatura int")
    q = spark.createDataFrame([(15, "7"), (14, "7"), (14, "8"), (None, "7"), (None, "9"), (13, "1"), (None, "77")], "leg int, num string")
    got = {(r.leg, r.num): r.pleno_id for r in fichas.by_number(q, s).collect()}
    assert got == {(15, "7"): "DSCD-15-PL-7", (14, "7"): "DSCD-14-PL-7", (14, "8"): "X-14-PL-8", (None, "7"): None, (None, "9"): "Y-PL-9", (13, "1"): None, (None, "77"): None}


def test_party_by_its_canonical_form(spark):
    labels = spark.createDataFrame([("PSOE", 5), ("Plural-Compromís", 3), ("Grupo Mixto", 9), ("Mixto", 1)], "label string, n int")
    q = spark.createDataFrame([(1, "los socialistas"), (2, "Compromís"), (3, "mixto"), (4, "Grupo  Parlamentario Foo"), (7, "Grupo Parlamentario Zeta"), (5, ""), (6, "pp")], "qid int, q string")
    # a word of three letters in a label is enough; a rule's form that no label has is the last resort
    assert {r.qid: r.label for r in resolve.party(q, labels).collect()} == {1: "PSOE", 2: "Plural-Compromís", 3: "Grupo Mixto", 4: "Grupo Mixto", 5: "", 6: "pp", 7: "Grupo Mixto"}


def test_overrides_hold_without_a_term(spark):
    sp = spark.createDataFrame([(None, "PÉREZ GIL", "", 1), (15, "PÉREZ GIL", "", 2)], "leg int, speaker string, paren string, i int")
    over = spark.createDataFrame([(None, "PEREZ GIL", "PNV"), (15, "PEREZ GIL", "PP")], "leg int, name string, sigla string")
    none = spark.createDataFrame([], "leg int, name string, sigla string")
    reg = spark.createDataFrame([], "leg int, key string, sigla string, canon string")
    assert {r.i: r.party for r in parties.attach(sp, over, none, reg).collect()} == {1: "PNV", 2: "PP"}


def test_the_short_slug_stays(spark):
    e = spark.createDataFrame([(1, "a", "ayto-chiva", "chiva", 9), (2, "a", "chiva", "chiva", 1), (3, "b", "x-1", "x", 2), (4, "b", "x-2", "x", 5), (5, "c", "solo-1", "solo", 0)], "id int, same string, slug string, short string, n int")
    c = spark.createDataFrame([(1, "t", 10), (2, "t", 11), (1, "u", 12), (3, "t", 13), (4, "t", 14), (5, "t", 15)], "entidad int, tema string, k int")
    got = sorted((r.entidad, r.slug, r.tema, r.k) for r in upserts.consolidated(e, c, ["tema"], "k").collect())
    assert got == [(2, "chiva", "t", 11), (2, "chiva", "u", 12), (4, "x", "t", 14), (5, "solo-1", "t", 15)]


def members(n):
    first, last = ["Ana", "Luis", "Marta", "Joan", "Íñigo", "Begoña", "Núria"], ["García", "Pérez", "Roca", "Etxeberria", "Puig", "Vázquez"]
    return [f"{first[i % 7]} {last[i % 6]} {last[i // 42 % 6]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(n)]


def plain_link(name, roster, least):
    best = max(((names.similarity(name, m), n) for m, n, _ in roster), default=(0, 0))
    hit = min((m for m, n, _ in roster if (names.similarity(name, m), n) == best), default=None)
    return (hit, next(p for m, _, p in roster if m == hit), round(best[0], 6)) if best[0] >= least and best[0] else (name, "", None)


def test_fuzzy_link_in_blocks(spark, monkeypatch):
    """Several blocks on both sides give what every pair gives."""
    monkeypatch.setattr(names, "ROSTER_BLOCK", 40)
    monkeypatch.setattr(names, "ASKED_BLOCK", 16)
    roster = [(m, i % 5, "PP" if i % 3 else "") for i, m in enumerate(members(150))] + [("de la", 1, "x"), ("García", 3, "PNV"), ("Garcia", 3, "PSOE")]
    asked = [m.replace("a", "e", 1).upper() for m in members(60)] + ["garcia", "zzz", "", "de", "Perez Puig", "Marta de Roca"]
    got = {r.name: (r.canon, r.party, r.sim) for r in names.fuzzy_link(spark.createDataFrame([(a,) for a in [*asked, None, "zzz"]], "name string"), spark.createDataFrame(roster, "canon string, n int, party string")).collect()}
    assert got == {a: plain_link(a, roster, 0.62) for a in asked}


def test_a_roster_of_any_size(spark):
    """20,001 names and more: no bound, and the names that are meant are found."""
    n = 30_000
    roster = spark.range(n).select(F.concat(F.lit("Nombre"), F.col("id"), F.lit(" Apellido"), F.col("id") * 7).alias("name"), F.lit(1).alias("n"))
    asked = spark.createDataFrame([(i, f"Tiene la palabra la señora Nombre{i} Apellido{i * 7}") for i in (3, 20_001, n - 1)] + [(n, "sin anuncio"), (n + 1, "palabra")], "id long, t string")
    assert {r.id: r.nombre for r in names.announced(asked, "id", "t", roster).collect()} == {i: f"Nombre{i} Apellido{i * 7}" for i in (3, 20_001, n - 1)}
    terms = roster.select(F.concat("name", F.lit("termino")).alias("term"))
    d = spark.createDataFrame([(1, "el Nombre20001 Apellido140007 termimo fue"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.text for r in lexicon.repaired(d, "id", "t", terms, spark.createDataFrame([("fue", "es")], "key string, canon string")).collect()}
    assert got[2] == "" and got[3] == "" and got[1].endswith("es")


def test_align_names_by_the_same_likeness():
    assert sequences.name_score("PÉREZ", "Perez") == 1.0 and sequences.name_score("Gobierno", "Ministro (Gobierno)") == 0.6
    assert np.isclose(sequences.name_score("Roca", "Roc"), 6 / 7)


def whole_table(s, gap, least):
    """The alignment by a table of all sums, and the way back through it."""
    n, m = s.shape
    d = np.zeros((n + 1, m + 1))
    d[:, 0], d[0] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    pair = np.where(s >= least, s, -9.0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = max(d[i - 1, j - 1] + pair[i - 1, j - 1], d[i - 1, j] + gap, d[i, j - 1] + gap)
    out, i, j = [], n, m
    while i and j:
        if np.isclose(d[i, j], d[i - 1, j - 1] + pair[i - 1, j - 1]):
            out += [(i - 1, j - 1)] if s[i - 1, j - 1] >= least else []
            i, j = i - 1, j - 1
        elif np.isclose(d[i, j], d[i - 1, j] + gap):
            i -= 1
        else:
            j -= 1
    return out[::-1]


@given(st.integers(1, 40), st.integers(1, 25), st.integers(0, 999))
@settings(max_examples=40, deadline=None)
def test_alignment_in_little_room(n, m, seed):
    s = np.random.default_rng(seed).integers(0, 5, (n, m)) / 4
    assert sequences.align(s, -0.3, 0.5) == whole_table(s, -0.3, 0.5)


def test_a_session_of_three_thousand_names(spark):
    r = np.random.default_rng(5)
    said = [f"N{i} A{i}" for i in r.integers(0, 40, 3000)]
    written_ = [n for k, n in enumerate(said) if k % 5]
    a = spark.createDataFrame([(1, i, n) for i, n in enumerate(said)], "pleno_id int, pos long, name string")
    b = spark.createDataFrame([(1, i, n) for i, n in enumerate(written_)], "pleno_id int, pos long, name string")
    got = sorted((r.a_pos, r.b_pos) for r in sequences.align_sessions(a, b).collect())
    names_ = sorted(set(said))
    table = np.array([[names.similarity(x, y) for y in names_] for x in names_])
    at = {x: i for i, x in enumerate(names_)}
    s = table[np.ix_([at[x] for x in said], [at[x] for x in written_])]
    # the best sum is that of all that was written; the pairs are in order and as good as can be
    assert all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:])) and all(s[i, j] >= 0.5 for i, j in got)
    total = sum(s[i, j] for i, j in got) - 0.3 * (len(said) + len(written_) - 2 * len(got))
    assert total >= len(written_) - 0.3 * (len(said) - len(written_)) - 1e-6


def test_random_pairs(spark):
    from estrado.operators import vectors

    r = np.random.default_rng(1)
    x = r.normal(size=(500, 4))
    d = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None, v.tolist()) for i, v in enumerate(x)], "id long, g string, vec array<double>")
    one = vectors.random_pairs(d, 300, seed=3).first()
    assert one == vectors.random_pairs(d.repartition(7), 300, seed=3).first() != vectors.random_pairs(d, 300, seed=4).first()
    s = x @ x.T
    every = (s.sum() - np.trace(s)) / (500 * 499)
    assert 290 <= one.pares <= 300 and abs(one.media - every) < 5 * one.error
    by = {r.g: r.pares for r in vectors.random_pairs(d, 50, by="g").collect()}
    assert set(by) == {"a", "b", None} and all(45 <= n <= 50 for n in by.values())
    assert vectors.random_pairs(d.limit(1), 5).count() == 0


def test_a_council_gazette(spark):
    text = (
        "Sumario. El presidente: nada de esto cuenta, es el sumario.\nSe abre la sesión a las nueve horas.\nEl presidente: Buenos días a todos y a todas. (Aplausos.) Empezamos. —\n"
        "El concejal del Grupo Municipal Socialista, don Ramón  Silva Buenadicha: Muchas gracias, presidente. (El señor Silva muestra un papel).\n"
        "La delegada, doña Engracia\nHidalgo Tena: Corto.\nEl secretario general : Se ha votado, y así constará.\n"
        "El portavoz de Vox, don Javier Diario de Sesiones del Pleno del Ayuntamiento de Madrid\nsesión ordinaria Núm. 1.234 Ortega Smith-Molina: Esto sigue en otra página"
    )
    got = [tuple(r) for r in one(spark, gz.council_speeches, text)]
    assert got == [
        ("El presidente", "", "presidencia", "Buenos días a todos y a todas. Empezamos. — "),
        ("Ramón Silva Buenadicha", "PSOE", "concejal", "Muchas gracias, presidente. . "),
        ("El secretario general", "", "presidencia", "Se ha votado, y así constará. "),
        ("Javier Ortega Smith-Molina", "VOX", "concejal", "Esto sigue en otra página"),
    ]
    assert one(spark, gz.council_speeches, "", "nadie habla", None) == [[], [], None]
