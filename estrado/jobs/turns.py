"""Turns, times and votes over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import record as rec
from ..operators import turns as op
from ..sources.tables import SEG, segments, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


W = "OVER (PARTITION BY pleno_id ORDER BY start, seg_id)"
TURNS = f"""f AS (SELECT *, CASE WHEN lag(speaker) {W} IS DISTINCT FROM speaker AND row_number() {W} > 1 THEN 1 ELSE 0 END nw FROM seg),
i AS (SELECT *, sum(nw) OVER (PARTITION BY pleno_id ORDER BY start, seg_id ROWS UNBOUNDED PRECEDING) turno FROM f)"""


@query(f"""WITH {SEG}, {TURNS} SELECT pleno_id, CAST(turno AS BIGINT) turno, any_value(speaker) speaker, min(start) start, max(struct_pack(a := start, b := seg_id, c := "end")).c "end", count(*) n,
string_agg(text, ' ' ORDER BY start, seg_id) text FROM i GROUP BY 1, 2""")
def turn_islands(spark, sf):
    return op.turns(segments(spark, sf))


@query(f"""WITH {SEG}, {TURNS} SELECT pleno_id, CAST(turno AS BIGINT) turno, any_value(speaker) speaker, min(start) desde, lead(min(start)) OVER (PARTITION BY pleno_id ORDER BY i.turno) hasta FROM i GROUP BY pleno_id, i.turno""")
def lead_slices(spark, sf):
    """Each turn lasts until the next one begins."""
    t = op.islands(segments(spark, sf)).groupBy("pleno_id", "turno").agg(F.first("speaker").alias("speaker"), F.min("start").alias("desde"))
    return t.withColumn("hasta", F.lead("desde").over(Window.partitionBy("pleno_id").orderBy("turno")))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


#: A chair's words by the turn's number, around words of the turn itself.
SAID = ["Interpelación urgente sobre ", "El diputado formula una pregunta: ", "Una interpelación de ", "Moción: ", "Proposición no de ley, ", "Comparecencia de ", "Convalidación de ", "Debate de investidura ", "Presupuestos ", ""]
SPOKEN = f"""c AS (SELECT conv_id pleno_id, turn, role, {SAID}[1 + (conv_id + turn) % 10] || regexp_replace(split_part(text, ' ', 1), '[^a-z]', '', 'g') || ' de la vivienda. Gracias' t FROM conversations), d AS (SELECT *, lower(t) low FROM c)"""


@query(f"""WITH {SPOKEN}, v AS (SELECT *, CASE WHEN role = 'user' THEN CASE WHEN starts_with(t, 'Interpelación urgente sobre ') THEN trim(regexp_replace(regexp_extract(t, 'sobre (.*)[.] Gracias', 1), '\\s+', ' ', 'g'), ' .,;')
{" ".join("WHEN " + " AND ".join(_any(w) for w in words) + f" THEN '{topic}'" for words, topic in rec.TOPICS)} END END x FROM d)
SELECT pleno_id, turn, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY pleno_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '') topic FROM v""".replace("\\\\", "\\"))
def topic_carry_forward(spark, sf):
    """The chair's announcement sets a topic by the ordered rules, which holds for all rows until the next one."""
    w = F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(1)), "[^a-z]", "")
    t = F.concat(F.element_at(F.array(*[F.lit(x) for x in SAID]), ((F.col("conv_id") + F.col("turn")) % 10 + 1).cast("int")), w, F.lit(" de la vivienda. Gracias"))
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("pleno_id"), "turn", F.col("turn").alias("start"), F.col("turn").alias("seg_id"), "role", t.alias("t"))
    return op.carried(c, F.when(F.col("role") == "user", rec.announced_topic(F.col("t"))), "topic").select("pleno_id", "turn", "topic")


@query("""WITH s AS (SELECT conv_id, turn, regexp_split_to_array(CASE turn % 3 WHEN 0 THEN 'Pasamos al real decreto de ' || conv_id % 4 || ' medidas urgentes. ' WHEN 1 THEN 'Reducción de la jornada a ' || turn || ' horas semanales; Para presentar la iniciativa. ' ELSE 'Tiene la palabra el señor diputado. ' END || 'Gracias', '\\s') q FROM conversations WHERE role = 'user'),
p AS (SELECT DISTINCT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Pasamos al real decreto de ' || conv_id % 4 || ' medidas urgentes.' WHEN 1 THEN 'Reducción de la jornada a ' || turn || ' horas semanales;' END s FROM s), f AS (SELECT conv_id, s, min(turn) t FROM p WHERE s IS NOT NULL GROUP BY 1, 2),
k AS (SELECT conv_id, s, t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, left(s, 50) ORDER BY t) k FROM f) WHERE k = 1) SELECT conv_id, left(string_agg(s, ' ' ORDER BY t), 800) orden FROM k GROUP BY 1""".replace("\\\\", "\\"))
def agenda_blind(spark, sf):
    """The agenda out of the chair's sentences: those that name a kind of point or are followed by who presents it, each beginning once, 800 characters."""
    m = F.col("turn") % 3
    t = F.when(m == 0, F.concat(F.lit("Pasamos al real decreto de "), (F.col("conv_id") % 4).cast("string"), F.lit(" medidas urgentes. "))).when(m == 1, F.concat(F.lit("Reducción de la jornada a "), F.col("turn").cast("string"), F.lit(" horas semanales; Para presentar la iniciativa. ")))
    c = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat(t.otherwise("Tiene la palabra el señor diputado. "), F.lit("Gracias")).alias("text"))
    return op.blind_agenda(c, "conv_id", "turn", "text").select("conv_id", F.col("agenda").alias("orden"))


@query("""WITH n AS (SELECT conv_id, turn, lead(text) OVER w a, lead(text, 2) OVER w b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, coalesce(a, '') || ' ' || coalesce(b, '') siguientes FROM n""")
def title_context(spark, sf):
    """What the two segments after one say, for the title of a point called in it."""
    return op.followed(table(spark, sf, "conversations"), "conv_id", "turn", "text", 2).select("conv_id", "turn", F.col("after").alias("siguientes"))


@query(f"""WITH p AS (SELECT user_id asiento, event_type fase, count(*) n, avg(CASE WHEN value >= 60 THEN 1.0 ELSE 0.0 END) frac FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY asiento ORDER BY CASE WHEN n >= 2 AND frac >= 0.34 THEN frac ELSE 0 END DESC, CASE fase WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) k FROM p), d AS (SELECT asiento, CASE WHEN n >= 2 AND frac >= 0.34 THEN fase END voto, frac FROM r WHERE k = 1)
SELECT coalesce(voto, 'ninguno') voto, count(*) n, count(*) FILTER (voto IS NOT NULL AND frac >= 0.60) seguros, coalesce(list_sort(list(asiento) FILTER (voto IS NOT NULL AND frac < 0.60)), []) revisar FROM d GROUP BY 1""")
def vote_counts(spark, sf):
    """Votes by phase, how many of them sure, and the seats to look at again; of equal shares the earlier phase."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    d = op.seat_votes(e.select(F.col("user_id").alias("asiento"), F.col("event_type").alias("fase"), F.col("value").alias("rel")), ["view", "click", "purchase"], REL, FRAC, MIN_DETS)
    unsure = F.when(F.col("voto").isNotNull() & (F.col("frac") < SURE), F.col("asiento"))
    return d.groupBy(F.coalesce("voto", F.lit("ninguno")).alias("voto")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("voto").isNotNull() & (F.col("frac") >= SURE)).alias("seguros"), F.sort_array(F.collect_list(unsure)).alias("revisar"))


@query(f"""WITH {SEG}, m AS (SELECT pleno_id, speaker, min(struct_pack(a := start, b := seg_id)) f FROM seg GROUP BY 1, 2) SELECT pleno_id, speaker, 'Voz ' || row_number() OVER (PARTITION BY pleno_id ORDER BY f) voz FROM m""")
def voice_ordinals(spark, sf):
    m = segments(spark, sf).groupBy("pleno_id", "speaker").agg(F.min(F.struct("start", "seg_id")).alias("f"))
    return m.select("pleno_id", "speaker", F.concat(F.lit("Voz "), F.row_number().over(Window.partitionBy("pleno_id").orderBy("f"))).alias("voz"))


@query(f"""WITH {SEG}, s AS (SELECT pleno_id, speaker, sum(greatest(0, "end" - start)) segundos FROM seg GROUP BY 1, 2)
SELECT *, round(segundos / CASE WHEN sum(segundos) OVER (PARTITION BY pleno_id) > 0 THEN sum(segundos) OVER (PARTITION BY pleno_id) ELSE 1 END, 6) cuota FROM s""")
def talk_time(spark, sf):
    return op.talk_time(segments(spark, sf), "speaker")


@query(f"""WITH {SEG} SELECT pleno_id, round(sum("end" - start) FILTER (speaker <> 'error') / sum("end" - start), 3) cobertura FROM seg GROUP BY 1 HAVING sum("end" - start) > 0""")
def coverage_ratio(spark, sf):
    d = F.col("end") - F.col("start")
    g = segments(spark, sf).groupBy("pleno_id").agg(F.sum(F.when(F.col("speaker") != "error", d)).alias("a"), F.sum(d).alias("b"))
    return g.filter("b > 0").select("pleno_id", F.round(F.col("a") / F.col("b"), 3).alias("cobertura"))


@query(f"""WITH {SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY pleno_id, speaker ORDER BY "end" - start DESC, seg_id) k FROM seg)
SELECT pleno_id, speaker, count(*) n, CAST(floor(sum("end" - start)) AS BIGINT) segundos, string_agg(text, '|' ORDER BY start, seg_id) FILTER (k <= 3) muestras FROM r GROUP BY 1, 2""")
def cluster_samples(spark, sf):
    """Of each voice its rows, seconds and three longest segments, these in the order of time."""
    seg = segments(spark, sf)
    k = F.row_number().over(Window.partitionBy("pleno_id", "speaker").orderBy(F.desc(F.col("end") - F.col("start")), "seg_id"))
    three = F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.struct("start", "seg_id", "text"))))
    g = seg.withColumn("k", k).groupBy("pleno_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(F.col("end") - F.col("start"))).alias("segundos"), three.alias("t"))
    return g.withColumn("muestras", F.array_join(F.transform("t", lambda x: x["text"]), "|")).drop("t")


@query(f"""WITH {SEG}, {TURNS}, t AS (SELECT pleno_id, speaker, count(DISTINCT turno) n FROM i GROUP BY 1, 2), s AS (SELECT pleno_id, speaker, sum("end" - start) segundos FROM seg GROUP BY 1, 2)
SELECT t.pleno_id, t.speaker, n, segundos FROM t LEFT JOIN s ON t.pleno_id = s.pleno_id AND t.speaker = s.speaker""")
def attendees(spark, sf):
    """Interventions and seconds of each speaker, in one aggregate over the turns."""
    t = op.islands(segments(spark, sf))
    return t.groupBy("pleno_id", "speaker").agg(F.countDistinct("turno").alias("n"), F.sum(F.col("end") - F.col("start")).alias("segundos"))


@query(f"""WITH {SEG}, c AS (SELECT pleno_id, speaker, count(*) n, min(seg_id) f FROM seg GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pleno_id ORDER BY n DESC, f) k FROM c) SELECT pleno_id, speaker, n FROM r WHERE k = 1""")
def label_mode(spark, sf):
    return op.mode_of(segments(spark, sf), ["pleno_id"], "speaker", "seg_id")


@query("SELECT conv_id, turn, text || ' ' || coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') contexto FROM conversations")
def context_window(spark, sf):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), F.coalesce(nxt, F.lit(""))).alias("contexto"))


@query(f"""WITH {SEG}, o AS (SELECT *, max("end") OVER (PARTITION BY pleno_id ORDER BY start, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start ov FROM seg),
f AS (SELECT *, CASE WHEN lag(speaker) {W} IS DISTINCT FROM speaker AND row_number() {W} > 1 THEN 1 ELSE 0 END nw FROM o),
i AS (SELECT *, sum(nw) OVER (PARTITION BY pleno_id ORDER BY start, seg_id ROWS UNBOUNDED PRECEDING) turno FROM f)
SELECT pleno_id, CAST(turno AS BIGINT) turno, count(*) FILTER (ov) * 1.0 / count(*) > 0.30 solape FROM i GROUP BY 1, 2""")
def cross_talk(spark, sf):
    """Turns of which more than 30 % of the segments begin before an earlier one has ended."""
    before = op.session().rowsBetween(Window.unboundedPreceding, -1)
    seg = segments(spark, sf).withColumn("ov", F.max("end").over(before) > F.col("start"))
    return op.islands(seg).groupBy("pleno_id", "turno").agg((F.count_if("ov") / F.count(F.lit(1)) > 0.30).alias("solape"))


@query(f"""WITH {SEG}, d AS (SELECT pleno_id, count(DISTINCT speaker) n FROM seg GROUP BY 1) SELECT seg.pleno_id, seg_id, CASE WHEN n <= 1 THEN 'Interviniente' ELSE speaker END speaker FROM seg JOIN d ON seg.pleno_id = d.pleno_id""")
def degenerate_override(spark, sf):
    """A session with one voice alone names nobody."""
    n = F.size(F.collect_set("speaker").over(Window.partitionBy("pleno_id")))
    return segments(spark, sf).select("pleno_id", "seg_id", F.when(n <= 1, "Interviniente").otherwise(F.col("speaker")).alias("speaker"))


@query(f"WITH {SEG} SELECT pleno_id, seg_id, pleno_id || '-' || lpad(CAST(row_number() {W} - 1 AS VARCHAR), 4, '0') id FROM seg")
def ordinal_ids(spark, sf):
    n = F.row_number().over(op.session()) - 1
    return segments(spark, sf).select("pleno_id", "seg_id", F.concat_ws("-", F.col("pleno_id").cast("string"), F.lpad(n.cast("string"), 4, "0")).alias("id"))


@query(f"""WITH {SEG} SELECT pleno_id, max("end") - min(start) duracion FROM seg WHERE text <> '' GROUP BY 1""")
def session_duration(spark, sf):
    return segments(spark, sf).filter("text <> ''").groupBy("pleno_id").agg((F.max("end") - F.min("start")).alias("duracion"))


@query(f"""WITH {SEG}, o AS (SELECT *, coalesce(max("end") OVER (PARTITION BY pleno_id ORDER BY start, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start, false) ov FROM seg),
c AS (SELECT *, count(*) FILTER (NOT ov) OVER (PARTITION BY pleno_id, speaker) limpios FROM o) SELECT pleno_id, seg_id, ov FROM c WHERE "end" - start >= 2.5 AND (NOT ov OR limpios = 0)""")
def clean_spans(spark, sf):
    """The spans of a voice free of others, or all of them where none is; 2.5 s at least."""
    before = op.session().rowsBetween(Window.unboundedPreceding, -1)
    seg = segments(spark, sf).withColumn("ov", F.coalesce(F.max("end").over(before) > F.col("start"), F.lit(False)))
    clean = F.count_if(~F.col("ov")).over(Window.partitionBy("pleno_id", "speaker"))
    return seg.withColumn("limpios", clean).filter((F.col("end") - F.col("start") >= 2.5) & (~F.col("ov") | (F.col("limpios") == 0))).select("pleno_id", "seg_id", "ov")


@query(f"""WITH {SEG}, s AS (SELECT * FROM seg WHERE speaker = 'view'), t AS (SELECT * FROM seg WHERE speaker <> 'view'),
h AS (SELECT s.pleno_id, s.seg_id, t.speaker, sum(least(s."end", t."end") - greatest(s.start, t.start)) o, min(t.start) f, any_value(s."end" - s.start) d FROM s JOIN t ON s.pleno_id = t.pleno_id AND s.start < t."end" AND t.start < s."end" GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY pleno_id, seg_id ORDER BY o DESC, f, speaker) k FROM h),
x AS (SELECT pleno_id, seg_id, max(speaker) FILTER (k = 1) speaker, max(o) solape_s, coalesce(bool_or(k = 2 AND o >= 0.6 AND o >= 0.3 * d), false) overlap FROM r GROUP BY 1, 2)
SELECT s.pleno_id, s.seg_id, x.speaker, solape_s, coalesce(overlap, false) overlap FROM s LEFT JOIN x ON s.pleno_id = x.pleno_id AND s.seg_id = x.seg_id""")
def overlap_assign(spark, sf):
    seg = segments(spark, sf)
    return op.overlap_assign(seg.filter("speaker = 'view'"), seg.filter("speaker <> 'view'")).select("pleno_id", "seg_id", "speaker", "solape_s", "overlap")


POINTS = """pt AS (SELECT pleno_id, start AS at, CAST(row_number() OVER (PARTITION BY pleno_id ORDER BY start, seg_id) AS INTEGER) punto FROM seg WHERE speaker = 'signup')"""


def _points(seg):
    n = F.row_number().over(Window.partitionBy("pleno_id").orderBy("start", "seg_id"))
    return seg.filter("speaker = 'signup'").select("pleno_id", F.col("start").alias("at"), n.alias("punto"))


@query(f"""WITH {SEG}, {POINTS} SELECT seg.pleno_id, seg_id, coalesce(max(punto), 0) punto FROM seg LEFT JOIN pt ON seg.pleno_id = pt.pleno_id AND pt.at <= seg.start GROUP BY 1, 2""")
def agenda_point_asof(spark, sf):
    seg = segments(spark, sf)
    return op.as_of(seg, _points(seg)).select("pleno_id", "seg_id", "punto")


@query(f"""WITH {SEG}, {POINTS}, a AS (SELECT seg.pleno_id, seg_id, coalesce(max(punto), 0) punto, any_value(speaker) speaker, any_value(start) start FROM seg LEFT JOIN pt ON seg.pleno_id = pt.pleno_id AND pt.at <= seg.start GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN (lag(speaker) {W} IS DISTINCT FROM speaker OR lag(punto) {W} IS DISTINCT FROM punto) AND row_number() {W} > 1 THEN 1 ELSE 0 END nw FROM a),
i AS (SELECT *, sum(nw) OVER (PARTITION BY pleno_id ORDER BY start, seg_id ROWS UNBOUNDED PRECEDING) turno FROM f)
SELECT pleno_id, punto, count(DISTINCT turno) intervenciones FROM i GROUP BY 1, 2""")
def interventions_by_point(spark, sf):
    """A turn ends with the agenda point that it falls in."""
    seg = segments(spark, sf)
    t = op.islands(op.as_of(seg, _points(seg)), "speaker", "punto")
    return t.groupBy("pleno_id", "punto").agg(F.countDistinct("turno").alias("intervenciones"))


@query("""WITH x AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 5 THEN 1 ELSE 0 END nw FROM events),
c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY value RANGE UNBOUNDED PRECEDING) cluster FROM x) SELECT user_id, CAST(cluster AS BIGINT) asiento, count(*) n, round(median(value), 4) mediana FROM c GROUP BY 1, 2""")
def seat_gap_clusters(spark, sf):
    c = op.gap_clusters(table(spark, sf, "events").select("user_id", "value"), "user_id", "value", 5.0)
    return c.groupBy("user_id", F.col("cluster").alias("asiento")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", F.lit(0.5)), 4).alias("mediana"))


#: Hands: a detection counts as raised from REL on, a vote needs this share and number of frames; SURE marks high confidence.
REL, FRAC, MIN_DETS, SURE = 60.0, 0.34, 2, 0.60


@query("""WITH p AS (SELECT user_id asiento, event_type fase, count(*) n, avg(CASE WHEN value >= 60 THEN 1.0 ELSE 0.0 END) frac FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY asiento ORDER BY CASE WHEN n >= 2 AND frac >= 0.34 THEN frac ELSE 0 END DESC, CASE fase WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) k FROM p)
SELECT asiento, CASE WHEN n >= 2 AND frac >= 0.34 THEN fase END voto, round(frac, 6) frac, n >= 2 AND frac >= 0.60 segura FROM r WHERE k = 1""")
def vote_decision(spark, sf):
    """The phase in which a seat's hand is up in the largest share of frames, if that share is large; of equal ones the earlier."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("view", "click", "purchase"))
    d = op.seat_votes(e.select(F.col("user_id").alias("asiento"), F.col("event_type").alias("fase"), F.col("value").alias("rel")), ["view", "click", "purchase"], REL, FRAC, MIN_DETS)
    return d.select("asiento", "voto", F.round("frac", 6).alias("frac"), (F.col("voto").isNotNull() & (F.col("frac") >= SURE)).alias("segura"))


@query("""WITH v AS (SELECT date_trunc('day', ts) dia, count(*) FILTER (event_type = 'click') si, count(*) FILTER (event_type = 'error') contra FROM events GROUP BY 1)
SELECT strftime(dia, '%Y-%m-%d') dia, si, contra, CASE WHEN si > contra THEN 'Aprobado por mayoría' WHEN contra > si THEN 'Rechazado' ELSE 'Empate' END resultado FROM v""")
def vote_outcome(spark, sf):
    v = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dia")).agg(F.count_if(F.col("event_type") == "click").alias("si"), F.count_if(F.col("event_type") == "error").alias("contra"))
    outcome = F.when(F.col("si") > F.col("contra"), "Aprobado por mayoría").when(F.col("contra") > F.col("si"), "Rechazado").otherwise("Empate")
    return v.withColumn("resultado", outcome)


@query(f"""WITH {SEG}, {POINTS}, a AS (SELECT seg.pleno_id, seg_id, coalesce(max(punto), 0) punto, any_value(speaker) speaker FROM seg LEFT JOIN pt ON seg.pleno_id = pt.pleno_id AND pt.at <= seg.start GROUP BY 1, 2),
v AS (SELECT * FROM a WHERE speaker = 'purchase'), u AS (SELECT * FROM a WHERE speaker = 'click')
SELECT pleno_id, punto, seg_id, 'vision' fuente FROM v UNION ALL SELECT pleno_id, punto, seg_id, 'audio' FROM u WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.pleno_id = u.pleno_id AND v.punto = u.punto)""")
def vote_source_priority(spark, sf):
    """Votes seen at a point suppress those heard at it."""
    seg = segments(spark, sf)
    a = op.as_of(seg, _points(seg)).select("pleno_id", "punto", "seg_id", "speaker")
    seen, heard = a.filter("speaker = 'purchase'"), a.filter("speaker = 'click'")
    heard = heard.join(seen.select("pleno_id", "punto").distinct(), ["pleno_id", "punto"], "left_anti")
    return seen.select("pleno_id", "punto", "seg_id", F.lit("vision").alias("fuente")).union(heard.select("pleno_id", "punto", "seg_id", F.lit("audio")))


@query("""WITH s AS (SELECT CAST(unnest(range(0, 20)) AS INTEGER) asiento), d AS (SELECT event_id, value, asiento, abs(value - asiento * 10) dist FROM events, s),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, asiento) k FROM d) SELECT event_id, CASE WHEN dist <= 42 THEN asiento END asiento, round(dist, 6) dist FROM r WHERE k = 1""")
def nearest_seat(spark, sf):
    """The nearest of a fixed row of seats within three gaps."""
    seats = F.array(*[F.struct(F.abs(F.col("value") - i * 10).alias("dist"), F.lit(i).alias("asiento")) for i in range(20)])
    e = table(spark, sf, "events").select("event_id", F.array_min(seats).alias("s"))
    return e.select("event_id", F.when(F.col("s.dist") <= 42, F.col("s.asiento")).alias("asiento"), F.round("s.dist", 6).alias("dist"))


@query(f"""WITH {SEG}, a AS (SELECT pleno_id, min(start) FILTER (speaker = 'click') favor FROM seg GROUP BY 1), b AS (SELECT seg.pleno_id, any_value(favor) favor, min(start) FILTER (speaker = 'error' AND start >= favor) contra FROM seg JOIN a ON seg.pleno_id = a.pleno_id GROUP BY 1),
c AS (SELECT seg.pleno_id, any_value(favor) favor, any_value(contra) contra, min(start) FILTER (speaker = 'purchase' AND start >= contra) x FROM seg JOIN b ON seg.pleno_id = b.pleno_id WHERE contra > favor GROUP BY 1), d AS (SELECT *, CASE WHEN x > contra THEN x ELSE contra + contra - favor END abst FROM c),
e AS (SELECT seg.pleno_id, any_value(favor) favor, any_value(contra) contra, any_value(abst) abst, min(start) FILTER (speaker = 'signup' AND start >= abst) y FROM seg JOIN d ON seg.pleno_id = d.pleno_id GROUP BY 1)
SELECT pleno_id, round(favor, 1) favor, round(contra, 1) contra, round(abst, 1) abstencion, round(CASE WHEN y > abst THEN y ELSE abst + greatest(1.5, contra - favor) END, 1) fin FROM e""")
def vote_phases(spark, sf):
    """Calls of a vote in their order: for, against after it, abstentions after that or as long again; the end by its own word or as long again."""
    s = segments(spark, sf).select("pleno_id", "start", F.replace(F.replace(F.replace(F.replace("speaker", F.lit("click"), F.lit("a favor")), F.lit("error"), F.lit("en contra")), F.lit("purchase"), F.lit("abstenciones")), F.lit("signup"), F.lit("se aprueba")).alias("word"))
    return op.vote_phases(s, "pleno_id")


@query("""WITH p AS (SELECT event_type fase, date_trunc('hour', ts) t, count(*) FILTER (value >= 60) n, count(*) manos FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fase ORDER BY n DESC, t) k FROM p)
SELECT fase, strftime(t, '%Y-%m-%d %H') hora, n, manos, k = 1 pico FROM r""")
def peak_frame(spark, sf):
    """Hands up by phase and frame (here an hour), and each phase's first frame with most of them."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("fase"), F.date_trunc("hour", "ts").alias("t"), F.col("value").alias("rel"))
    return op.frame_profile(e, REL).select("fase", F.date_format("t", "yyyy-MM-dd HH").alias("hora"), "n", "manos", "pico")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_extendedprice ys, l_extendedprice * (1 - l_discount) yh, l_extendedprice - l_quantity * 100 yw, l_extendedprice - l_quantity * 50 ye, l_linenumber % 5 / 10.0 cw, l_linenumber % 7 / 10.0 ce FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN ys - yh >= 4 THEN round((ys - CASE WHEN cw > 0.25 THEN yw WHEN ce > 0.50 THEN ye END) / (ys - yh), 6) END rel FROM h""")
def hand_height(spark, sf):
    """Height of a hand over the shoulders in heads, by the wrist or, where that is doubtful, the elbow; null where neither is seen or shoulder and head are less than 4 apart."""
    y, q, k = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double"), F.col("l_linenumber")
    zero, one = F.lit(0.0), F.lit(1.0)
    points = {"head0": y * (1 - F.col("l_discount").cast("double")), "shoulder0": y, "shoulder1": y, "wrist0": y - q * 100, "elbow0": y - q * 50, "wrist1": y, "elbow1": y, **{f"head{i}": y for i in range(1, 5)}}
    sure = {"head0": one, "shoulder0": one, "shoulder1": zero, "wrist0": k % 5 / 10.0, "elbow0": k % 7 / 10.0, "wrist1": zero, "elbow1": zero, **{f"head{i}": zero for i in range(1, 5)}}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(rec.hand(points, sure), 6).alias("rel"))


@query(f"""WITH {SEG} SELECT pleno_id, seg_id FROM seg WHERE start >= 1704448800 AND start < 1704535200""")
def time_slice(spark, sf):
    """Start inclusive, end exclusive."""
    return segments(spark, sf).filter((F.col("start") >= 1704448800) & (F.col("start") < 1704535200)).select("pleno_id", "seg_id")
