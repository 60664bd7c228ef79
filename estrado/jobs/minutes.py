"""Minutes, transcripts and reports over the given tables, and the SQL of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import minutes as op
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NAMES = ["Presidencia", "Ana María López", "Gobierno", "Ti Zabal", "Joan de la Mata Prim", ""]
PARTIES = ["", "PP", "", "VOX", "", "PSOE"]
CALLS = ["uno", "segundo", "número tres", "nº 4", "décimo"]
SAID = [
    "Queda aprobado por mayoría, sin votos en contra. ", "Votos emitidos, 350; a favor, 170; en contra, 180; abstenciones, 0. Luego 3 votos a favor, 2 en contra. ", "Se aprueba la propuesta, dijo. ", "Por asentimiento se rechaza. ",
]


def recorded(spark, sf):
    """Conversations as recorded sessions: a turn lasts some seconds, voices and names follow from its numbers; some call a point, some tell a vote."""
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    c, turn = F.col("conv_id"), F.col("turn")
    voice = (c + turn * turn) % 6
    call = F.when(turn % 4 == 1, F.concat(F.lit("Pasamos al punto "), pick(CALLS, (c + turn) % 5), F.lit(". ")))
    vote = F.when(turn % 3 == 2, pick(SAID, (c + turn) % 4))
    text = F.when(turn % 13 == 12, "  ").otherwise(F.concat(F.coalesce(call, F.lit("")), F.coalesce(vote, F.lit("")), "text"))
    return table(spark, sf, "conversations").select(
        c.alias("pleno_id"), turn.cast("long").alias("seg_id"), (turn * 9).cast("double").alias("start"), (turn * 9 + F.length("text") % 12).cast("double").alias("end"), text.alias("text"),
        F.when(voice != 5, F.concat(F.lit("V"), voice)).alias("speaker"), pick(NAMES, (voice + F.when(turn % 10 == 9, 1).otherwise(0)) % 6).alias("name"), pick(PARTIES, voice).alias("party"), ((c + turn) % 3 == 0).alias("overlap"),
    )


def sessions(spark, sf):
    """A head for two of three sessions."""
    c = F.col("conv_id")
    s = table(spark, sf, "conversations").select("conv_id").distinct().filter("conv_id % 3 < 2")
    return s.select(c.alias("pleno_id"), F.when(c % 2 == 0, "Ayuntamiento de Chiva").alias("entidad"), F.concat(F.lit("2026-1-"), (c % 28 + 1).cast("string")).alias("fecha"), F.when(c % 3 == 1, F.concat(F.lit("Pleno "), c.cast("string"))).alias("titulo"))


def agenda(spark, sf):
    """Official points of every fourth session, one more than are called in most."""
    s = table(spark, sf, "conversations").select("conv_id").distinct().filter("conv_id % 4 = 0")
    return s.select(F.col("conv_id").alias("pleno_id"), F.posexplode(F.array(F.lit("Lectura del acta"), F.lit("Ruegos y preguntas"))).alias("punto", "title")).withColumn("punto", F.col("punto") + 1)


def seen(spark, sf):
    """Votes counted in the picture, from events: a user's purchases."""
    e = table(spark, sf, "events").filter("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("pleno_id"), F.col("event_id").alias("k"), (F.col("event_id") % 60).cast("double").alias("t"), F.floor("value").cast("int").alias("a_favor"), (F.col("event_id") % 40).cast("int").alias("en_contra"), F.lit(1).alias("abstencion"))


@query()
def minutes_document(spark, sf):
    """The minutes of every session as one text: head, speakers, agenda, times, speeches by point, votes seen before votes heard."""
    return op.documents(op.blocks(recorded(spark, sf), sessions(spark, sf), agenda(spark, sf), seen(spark, sf)))


SPOKEN = """p AS (SELECT conv_id pleno_id, turn, text, turn * 9 s FROM conversations WHERE trim(text) <> '')"""


@query(f"""WITH {SPOKEN} SELECT pleno_id, {" || chr(10) || ".join(f"'{x}'" for x in op.TRANSCRIPT_HEAD)} || chr(10) || 'Pleno: ' || pleno_id || chr(10) || repeat('=', 60) || chr(10) || chr(10)
|| string_agg(printf('[%d:%02d:%02d]  ', s // 3600, s // 60 % 60, s % 60) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY turn) text FROM p GROUP BY 1""")
def transcript_review(spark, sf):
    """The words as recognised, each with its time, under a head."""
    return op.documents(op.transcript(recorded(spark, sf).drop("text").join(table(spark, sf, "conversations").select(F.col("conv_id").alias("pleno_id"), F.col("turn").cast("long").alias("seg_id"), "text"), ["pleno_id", "seg_id"])))


@query(f"""WITH {SPOKEN}, v AS (SELECT *, coalesce('V' || NULLIF((pleno_id + turn * turn) % 6, 5), '?') sp FROM p), o AS (SELECT pleno_id, sp, row_number() OVER (PARTITION BY pleno_id ORDER BY min(turn)) v FROM v GROUP BY 1, 2)
SELECT pleno_id, count(*) n, max(v.turn * 9.0) hasta, string_agg(o.v, ' ' ORDER BY turn) voces FROM v JOIN o USING (pleno_id, sp) GROUP BY 1""")
def viewer_voices(spark, sf):
    """The rows of the page that follows a recording, read back out of their JSON: how many, the last time, and the voices in order."""
    seg = recorded(spark, sf).drop("text").join(table(spark, sf, "conversations").select(F.col("conv_id").alias("pleno_id"), F.col("turn").cast("long").alias("seg_id"), "text"), ["pleno_id", "seg_id"])
    r = op.viewer_rows(seg).select("pleno_id", F.from_json("rows", "array<struct<t:double,v:int,x:string>>").alias("r"))
    return r.select("pleno_id", F.size("r").cast("long").alias("n"), F.array_max(F.transform("r", lambda x: x["t"])).alias("hasta"), F.array_join(F.transform("r", lambda x: x["v"].cast("string")), " ").alias("voces"))


@query()
def comparison_report(spark, sf):
    """A table of our interventions beside the official ones for each session, and what we lack."""
    c = recorded(spark, sf).filter("trim(text) <> ''").select("pleno_id", "seg_id", "name", "text")
    pairs = c.filter("seg_id % 4 <> 3").select("pleno_id", F.col("seg_id").alias("a_pos"), F.col("seg_id").alias("b_pos"), ((F.col("seg_id") % 7) / 7).alias("sim"), F.concat("name", F.lit(" de la")).alias("ours"), F.upper("name").alias("theirs"), F.col("text").alias("our_text"), F.reverse("text").alias("their_text"))
    totals = c.groupBy("pleno_id").agg((F.count_if(F.col("seg_id") % 4 != 3) / F.count(F.lit(1))).alias("cobertura"), F.lit(0.5).alias("acierto"), F.lit(0.75).alias("fidelidad"))
    return op.documents(op.comparison(pairs, c.select("pleno_id", F.col("seg_id").alias("pos"), "name"), totals))
