"""The minutes of a session as one text, put together from typed blocks.

Every part of the document is a table of blocks (pleno_id, part, a, b, c, text): lines that stand together, and the key that they are ordered by. Voices are named, points
called, votes placed and times counted for all sessions at once, from one written table of labelled segments; one sort by the keys then lays the
blocks of all sessions out, and a document is its blocks in order.

Segments are (pleno_id, seg_id, start, end, text, speaker, name, party, overlap): speaker is the voice, name and party what is believed of it. A null start is 0, null texts and names are empty.
Segments of one start stand in the order of seg_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import record as rec
from ..functions.text import clock, long_date
from . import turns
from .components import written

#: Fixed values of the document.
CHAMBER = "Congreso de los Diputados"
RULE = "=" * 70
GOVERNMENT_MEMBER = "(miembro del Gobierno)"
NOBODY = ["", "(sin identificar)"]
UNCONFIRMED = "(Nombres automáticos SIN CONFIRMAR — pendientes de etiquetado/validación.)"
NO_POINTS = "  (Los puntos no se han detectado automáticamente;\n   se completan con la convocatoria / orden del día oficial.)"
NOT_HEARD = "        (del orden del día; no localizado en el audio)"
CROSSED = "(Cruce de intervenciones.) "
TRANSCRIPT_HEAD = ["TRANSCRIPCIÓN ORIGINAL (texto literal del reconocimiento de voz, SIN editar).", "Para revisión: comprueba aquí si hubo algún error de transcripción.", ""]
NAME_CONNECTORS = ["i", "y", "e", "de", "del", "la", "las", "los", "el", "da", "do", "san", "von"]
#: Speakers in the list of times.
LISTED = 15


def _trim(c: str) -> Column:
    return rec.squeeze_ends(rec.text_of(F.col(c)))


def _hms(c: Column) -> Column:
    return clock(F.coalesce(c, F.lit(0.0)), pad=False)


def _left(c: Column, n: int) -> Column:
    """Cut at n characters and filled up to n."""
    return F.rpad(F.left(c, F.lit(n)), n, " ")


def _right(c: Column, n: int) -> Column:
    """Filled from the left to n characters, never cut."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(n) - F.length(c))), c)


def _times(n: Column) -> Column:
    return F.when(n == 1, "1 intervención").otherwise(F.concat(n.cast("string"), F.lit(" intervenciones")))


def plausible(name: Column) -> Column:
    """Whether a name that was found by itself may be shown: two words and more besides connectors, each of three letters and more."""
    words = F.filter(F.split(name, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*NAME_CONNECTORS))
    return (F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) >= 3)


def labelled(seg: DataFrame) -> DataFrame:
    """seg with name and party as the session's voices are called, and auto where that is a name nobody confirmed; written.

    A voice bears the name and the party that most of its segments have, of equals those met first. The chair and members of the government are called so; a name that is missing, a marker or not
    plausible becomes 'Voz n', n by the voice's first segment (0 without a voice). A session in which all segments have one name has named nobody: all are 'Voz n'.
    """
    s = seg.select("pleno_id", "seg_id", F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"), _trim("text").alias("text"), "speaker", _trim("name").alias("name"), _trim("party").alias("party"), F.coalesce("overlap", F.lit(False)).alias("overlap"))
    s = written(s, "segments").withColumn("o", F.struct("start", "seg_id"))
    named = s.groupBy("pleno_id", "speaker", "name").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    voice, session = Window.partitionBy("pleno_id", "speaker"), Window.partitionBy("pleno_id")
    named = named.withColumn("first", F.min("o").over(voice)).withColumn("one", F.min("name").over(session) == F.max("name").over(session))
    named = named.withColumn("k", F.row_number().over(voice.orderBy(F.desc("n"), "o"))).filter("k = 1")
    party = s.groupBy("pleno_id", "speaker", "party").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    party = party.withColumn("k", F.row_number().over(voice.orderBy(F.desc("n"), "o"))).filter("k = 1").select("pleno_id", F.col("speaker").alias("_v"), F.col("party").alias("_p"))
    v = named.join(party, (named.pleno_id == party.pleno_id) & named.speaker.eqNullSafe(party._v)).select(named.pleno_id, "speaker", "name", "first", "one", "_p")
    # voices alone are numbered, segments without one come last
    number = F.when(F.col("speaker").isNotNull(), F.row_number().over(session.orderBy(F.col("speaker").isNull(), "first"))).otherwise(0)
    voz = F.concat(F.lit("Voz "), number.cast("string"))
    blind = F.col("one") | F.col("name").isin(*NOBODY) | F.rlike("name", F.lit(r"^Voz \d+$")) | ~plausible(F.col("name"))
    chair, member = ~F.col("one") & (F.col("name") == "Presidencia"), ~F.col("one") & F.col("name").isin(GOVERNMENT_MEMBER, "Gobierno")
    label = F.when(chair, "Presidencia").when(member, GOVERNMENT_MEMBER).when(blind, voz).otherwise(F.col("name"))
    own = ~chair & ~member & ~blind
    v = v.select("pleno_id", F.col("speaker").alias("_v"), label.alias("_n"), F.when(own, F.col("_p")).otherwise("").alias("_p"), own.alias("auto"))
    s = s.drop("o", "name", "party").alias("s").join(v.alias("v"), (F.col("s.pleno_id") == F.col("v.pleno_id")) & F.col("s.speaker").eqNullSafe(F.col("v._v")))
    s = s.select("s.*", F.col("_n").alias("name"), F.col("_p").alias("party"), "auto")
    return written(s.withColumn("who", rec.speaker_label(F.col("name"), F.col("party"))), "labelled")


def points(seg: DataFrame, agenda: DataFrame | None = None) -> DataFrame:
    """(pleno_id, punto, at, title): the points that were called, numbered from 1. An official agenda(pleno_id, punto, title) gives the titles, and the points that nobody called, without a time."""
    p = turns.called_points(seg)
    p = p.withColumn("punto", F.row_number().over(turns.session())).select("pleno_id", "punto", F.col("start").alias("at"), "title")
    if agenda is None:
        return p
    a = agenda.select("pleno_id", "punto", F.col("title").alias("_t"))
    j = p.join(a, ["pleno_id", "punto"], "full")
    # points that are missing on the agenda keep what was heard
    return j.select("pleno_id", "punto", "at", F.coalesce("_t", "title").alias("title"))


def votes(seg: DataFrame, called: DataFrame, seen: DataFrame | None) -> DataFrame:
    """(pleno_id, punto, at, seg_id, i, line): votes seen(pleno_id, k, t, a_favor, en_contra, abstencion), in the order of k, and those heard at points where none was seen."""
    heard = turns.as_of(seg, called).select("pleno_id", "punto", F.col("start").alias("at"), "seg_id", F.posexplode(rec.vote_lines(F.col("text"))).alias("i", "line"))
    if seen is None:
        return heard
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    outcome = F.when(n("a_favor") > n("en_contra"), "Aprobado por mayoría").when(n("en_contra") > n("a_favor"), "Rechazado").otherwise("Empate")
    line = F.concat(F.lit("a favor "), n("a_favor").cast("string"), F.lit(", en contra "), n("en_contra").cast("string"), F.lit(", abstenciones "), n("abstencion").cast("string"), F.lit(" (recuento aproximado por visión del vídeo). "), outcome, F.lit("."))
    s = seen.select("pleno_id", F.coalesce("t", F.lit(0.0)).alias("start"), F.col("k").cast("long").alias("seg_id"), line.alias("line"))
    s = turns.as_of(s, called).select("pleno_id", "punto", F.col("start").alias("at"), "seg_id", F.lit(0).alias("i"), "line")
    s = s.withColumn("at", F.lit(0.0))
    return s.unionByName(heard.join(s.select("pleno_id", "punto").distinct(), ["pleno_id", "punto"], "left_anti"))


def blocks(seg: DataFrame, sessions: DataFrame | None = None, agenda: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(pleno_id, part, a, b, c, text) of the minutes of all sessions of seg; ordered by the key (part, a, b, c), a session's texts joined by line ends are its document.

    sessions(pleno_id, entidad, fecha, titulo) has the heads, agenda the official points, seen the votes that were counted in the picture; each may lack sessions, or be missing.
    """
    s = labelled(seg)
    # what is known of sessions that have no segments makes no minutes
    ids = s.select("pleno_id").distinct()
    agenda, seen = (x if x is None else x.join(ids, "pleno_id", "left_semi") for x in (agenda, seen))
    called = written(points(s.select("pleno_id", "seg_id", "start", "text"), agenda), "points")
    spoken = s.filter("text <> ''")
    # speech: runs of one speaker within a point
    at = turns.as_of(spoken, called)
    items = turns.turns(at, "who", "punto")
    crossed = turns.islands(at, "who", "punto").groupBy("pleno_id", "turno").agg((F.count_if("overlap") > 0.30 * F.count(F.lit(1))).alias("crossed"))
    items = written(items.join(crossed, ["pleno_id", "turno"]), "items")
    runs = turns.islands(spoken, "who").groupBy("pleno_id", "who", "turno").agg(F.min(F.struct("start", "seg_id")).alias("o"))
    runs = runs.groupBy("pleno_id", "who").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    # times: by speaker and party, segments without text too
    lasting = s.withColumn("d", F.col("end") - F.col("start")).filter("d > 0").withColumn("o", F.struct("start", "seg_id"))
    spent = lasting.groupBy("pleno_id", "who", "party").agg(F.sum("d").alias("sec"), F.min("o").alias("o"))
    by = lambda c: spent.groupBy("pleno_id", c).agg(F.sum("sec").alias("sec"), F.min("o").alias("o"))
    session = Window.partitionBy("pleno_id")
    ranked = lambda x: x.withColumn("k", F.row_number().over(session.orderBy(F.desc("sec"), "o")).cast("long"))
    total = F.sum("sec").over(session)
    speakers = ranked(by("who").withColumn("total", F.when(total > 0, total).otherwise(1.0)))
    parties = ranked(by("party").filter("party <> ''")).join(speakers.select("pleno_id", "total").distinct(), "pleno_id")
    auto = s.filter("auto").select("pleno_id", "who").distinct().withColumn("auto", F.lit(True))
    seats = runs.join(speakers.select("pleno_id", "who", "sec"), ["pleno_id", "who"], "left").join(auto, ["pleno_id", "who"], "left").withColumn("sec", F.coalesce("sec", F.lit(0.0)))

    head = s.groupBy("pleno_id").agg(F.max(F.when(F.col("text") != "", F.col("end"))).alias("z"), F.min(F.when(F.col("text") != "", F.col("start"))).alias("a"), F.max("auto").alias("auto"), F.countDistinct(F.when(F.col("text") != "", F.col("who"))).alias("n"))
    head = head.join(called.groupBy("pleno_id").agg(F.count(F.lit(1)).alias("points")), "pleno_id", "left").join(parties.select("pleno_id").distinct().withColumn("parties", F.lit(True)), "pleno_id", "left")
    if sessions is not None:
        head = head.join(sessions.select("pleno_id", "entidad", "fecha", "titulo"), "pleno_id", "left")
    else:
        head = head.withColumns({c: F.lit(None).cast("string") for c in ("entidad", "fecha", "titulo")})
    head = written(head.withColumn("dur", _hms(F.col("z") - F.col("a"))), "heads")

    zero = F.lit(0).cast("long")

    def part(x: DataFrame, number: int, text: Column, a: Column = zero, b: Column = zero, c: Column = zero, at: Column | None = None) -> DataFrame:
        order = F.coalesce(at, F.lit(0.0)) if at is not None else F.lit(0.0)
        return x.select("pleno_id", F.lit(number).alias("part"), a.cast("long").alias("a"), order.alias("at"), b.cast("long").alias("b"), c.cast("long").alias("c"), text.alias("text"))

    lines = lambda *x: F.concat_ws("\n", *x)
    title = lambda t: F.lit(f"\n{RULE}\n{t}\n{RULE}\n")
    body, date = F.coalesce(F.nullif("entidad", F.lit("")), F.lit(CHAMBER)), long_date(rec.text_of(F.col("fecha")))
    opening = lines(
        F.lit("ACTA DE LA SESIÓN PLENARIA"), F.concat(body, F.when(date != "", F.concat(F.lit(" — "), date)).otherwise("")), F.nullif(_trim("titulo"), F.lit("")), F.lit(""),
        F.concat(F.lit("Se abre la sesión. Duración: "), F.col("dur"), F.lit(". Intervienen "), F.col("n").cast("string"), F.lit(" oradores.")), title("ASISTENTES (oradores)"), F.when(F.col("auto"), F.lit(UNCONFIRMED + "\n")),
    )
    seat = F.concat(F.lit("  "), _left(F.col("who"), 42), F.lit("  "), _right(_times(F.col("n")), 16), F.lit("  ·  "), _hms(F.col("sec")), F.when(F.col("auto"), "   (sin confirmar)").otherwise(""))
    nint = items.filter("punto > 0").groupBy("pleno_id", "punto").agg(F.count(F.lit(1)).alias("n"))
    numbered = called.join(nint, ["pleno_id", "punto"], "left")
    place = F.when(F.col("at").isNotNull(), F.concat(F.lit("        inicio "), _hms(F.col("at")), F.lit(" · "), _times(F.coalesce("n", F.lit(0))))).otherwise(NOT_HEARD)
    point = lines(F.concat(F.lit("  "), F.col("punto").cast("string"), F.lit(".  "), "title"), place)
    share = lambda c: F.concat(F.lit("  "), _left(F.col(c), 34), F.lit(" "), _right(_hms(F.col("sec")), 9), F.lit("  ("), F.bround(F.col("sec") / F.col("total") * 100).cast("int").cast("string"), F.lit("%)"))
    said = F.concat(F.lit("["), _hms(F.col("start")), F.lit("] "), "who", F.lit(":\n    "), F.when(F.col("crossed"), CROSSED).otherwise(""), "text", F.lit("\n"))
    heads = numbered.filter("n > 0")
    p = F.col("punto")
    all_ = [
        part(head, 0, opening),
        part(ranked(seats), 1, seat, F.col("k")),
        part(head, 2, title("ORDEN DEL DÍA")),
        part(head.filter("points is null"), 3, F.lit(NO_POINTS)),
        part(numbered, 3, point, p),
        part(head, 4, F.concat(title("ESTADÍSTICAS"), F.lit("\nTiempo por orador:"))),
        part(speakers.filter(F.col("k") <= LISTED), 5, share("who"), F.col("k")),
        part(head.filter("parties"), 6, F.lit("\nTiempo por partido:")),
        part(parties, 7, share("party"), F.col("k")),
        part(head, 8, title("DESARROLLO DE LA SESIÓN")),
        part(heads, 9, F.concat(F.lit("\n----- PUNTO "), p.cast("string"), F.lit(".  "), "title", F.lit(" -----\n")), 3 * p),
        part(items, 9, said, 3 * p + 1, F.col("turno")),
        part(votes(s, called, seen), 9, F.concat(F.lit("    » VOTACIÓN: "), "line", F.lit("\n")), 3 * p + 2, F.col("seg_id"), F.col("i"), F.col("at")),
        part(head, 10, F.concat(F.lit("\nSe levanta la sesión. (Duración total: "), "dur", F.lit(".)"))),
    ]
    return reduce(DataFrame.unionByName, all_)


KEY = ("part", "a", "at", "b", "c")


def documents(parts: DataFrame) -> DataFrame:
    """(pleno_id, text): a text for each session. A row is a session's document, so its size is what a document's is."""
    g = parts.groupBy("pleno_id").agg(F.sort_array(F.collect_list(F.struct(*KEY, "text"))).alias("l"))
    return g.select("pleno_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def write(parts: DataFrame, path: str) -> None:
    """A folder pleno_id=... with one text file for each session. Blocks are sorted within their session and streamed out; no document is held as a whole."""
    parts.repartition("pleno_id").sortWithinPartitions("pleno_id", *KEY).select("pleno_id", "text").write.partitionBy("pleno_id").text(path)


def transcript(seg: DataFrame) -> DataFrame:
    """Blocks of the words as they were recognised, a time before each, for review; documents() and write() take them."""
    s = seg.select("pleno_id", "seg_id", F.coalesce("start", F.lit(0.0)).alias("at"), _trim("text").alias("text"))
    zero = F.lit(0).cast("long")
    first = s.select("pleno_id").distinct().select("pleno_id", F.lit(0).alias("part"), zero.alias("a"), F.lit(0.0).alias("at"), zero.alias("b"), zero.alias("c"), F.concat(F.lit("\n".join([*TRANSCRIPT_HEAD, "Pleno: "])), F.col("pleno_id").cast("string"), F.lit("\n" + "=" * 60 + "\n")).alias("text"))
    line = F.concat(F.lit("["), _hms(F.col("at")), F.lit("]  "), "text")
    return first.unionByName(s.filter("text <> ''").select("pleno_id", F.lit(1).alias("part"), zero.alias("a"), "at", F.col("seg_id").cast("long").alias("b"), zero.alias("c"), line.alias("text")))


def viewer_rows(seg: DataFrame) -> DataFrame:
    """(pleno_id, rows): a JSON list of {t, v, x}, time, number of the voice by its first words, and text, in order; for a page that follows the recording."""
    s = seg.select("pleno_id", F.struct(F.coalesce("start", F.lit(0.0)).alias("start"), "seg_id").alias("o"), _trim("text").alias("text"), F.coalesce("speaker", F.lit("?")).alias("speaker")).filter("text <> ''")
    v = s.groupBy("pleno_id", "speaker").agg(F.min("o").alias("first"))
    v = v.select("pleno_id", "speaker", F.row_number().over(Window.partitionBy("pleno_id").orderBy("first")).alias("v"))
    s = s.join(v, ["pleno_id", "speaker"]).select("pleno_id", "o", F.struct(F.bround("o.start", 1).alias("t"), "v", F.col("text").alias("x")).alias("r"))
    g = s.groupBy("pleno_id").agg(F.sort_array(F.collect_list(F.struct("o", "r"))).alias("l"))
    return g.select("pleno_id", F.to_json(F.transform("l", lambda x: x["r"])).alias("rows"))


def comparison(pairs: DataFrame, official: DataFrame, totals: DataFrame, alike: float = 0.6) -> DataFrame:
    """Blocks of a report for each session of totals(pleno_id, cobertura, acierto, fidelidad): our interventions beside the official ones, and the official ones that we lack.

    pairs(pleno_id, a_pos, b_pos, sim, ours, theirs, our_text, their_text) are the aligned interventions, official(pleno_id, pos, name) all of the official record. Names agree from alike on, by names.similarity().
    """
    from .names import same_person

    zero, cut = F.lit(0).cast("long"), lambda c: F.concat(F.translate(F.left(rec.text_of(F.col(c)), F.lit(100)), "|\n", "  "), F.lit("…"))
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    block = lambda x, n, a, text: x.select("pleno_id", F.lit(n).alias("part"), a.cast("long").alias("a"), F.lit(0.0).alias("at"), zero.alias("b"), zero.alias("c"), text.alias("text"))
    head = F.concat(
        F.lit("# Acta generada vs Diario oficial — "), F.col("pleno_id").cast("string"), F.lit("\n\n- Cobertura: "), percent("cobertura"), F.lit("  ·  Acierto de orador: "), percent("acierto"), F.lit("  ·  Fidelidad: "), F.format_string("%.3f", "fidelidad"),
        F.lit("\n\n| # | Orador (nuestro) | Orador (oficial) | ¿coincide? | sim | nuestro texto | texto oficial |\n|---|---|---|---|---|---|---|"),
    )
    k = F.row_number().over(Window.partitionBy("pleno_id").orderBy("b_pos", "a_pos"))
    p = pairs.withColumn("k", k).withColumn("ok", same_person(alike)("ours", "theirs"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("k").cast("string"), "ours", "theirs", F.when(F.col("ok"), "sí").otherwise("**NO**"), F.format_string("%.2f", "sim"), cut("our_text"), cut("their_text")), F.lit(" |"))
    lost = official.join(pairs.select("pleno_id", F.col("b_pos").alias("pos")), ["pleno_id", "pos"], "left_anti").groupBy("pleno_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("l"))
    lost = lost.withColumn("text", F.concat(F.lit("\n**Intervenciones oficiales NO capturadas:** "), F.array_join(F.transform("l", lambda x: x["name"]), ", ")))
    return block(totals, 0, zero, head).unionByName(block(p, 1, F.col("k"), row)).unionByName(block(lost.join(totals.select("pleno_id"), "pleno_id"), 2, zero, F.col("text")))
