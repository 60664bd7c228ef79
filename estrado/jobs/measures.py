"""Quality measures, labels and projections over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import record as rec
from ..functions import text as tx
from ..operators import fichas, names, sequences
from ..operators import vectors as vec
from ..sources.tables import IV, SEG, interventions, segments, table
from .parties import people

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {IV}, k AS (SELECT *, speaker || ' (' || party || ')' etiqueta FROM iv WHERE lower(role) <> 'presidencia' AND party <> 'Presidencia' AND n_words >= 20)
SELECT pleno_id, idx, CAST(row_number() OVER (PARTITION BY pleno_id ORDER BY idx, speaker, party) - 1 AS INTEGER) i, CAST(row_number() OVER (PARTITION BY pleno_id ORDER BY idx, speaker, party) AS INTEGER) hasta, etiqueta FROM k""")
def to_transcript(spark, sf):
    """Interventions as segments: the chair's and short ones go, a row lasts one step, the label is speaker and party."""
    k = interventions(spark, sf).filter(fichas.substantive() & (F.col("n_words") >= 20))
    n = F.row_number().over(Window.partitionBy("pleno_id").orderBy("idx", "speaker", "party"))
    return k.select("pleno_id", "idx", (n - 1).alias("i"), n.alias("hasta"), F.concat("speaker", F.lit(" ("), "party", F.lit(")")).alias("etiqueta"))


@query("""WITH e AS (SELECT vec_id id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings), s AS (SELECT q.id qid, e.id, list_sum(list_transform(range(1, 65), lambda i: q.v[i] * e.v[i])) sim FROM e q, e WHERE q.id % 20 = 0 AND e.label NOT IN (0, 7)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) k FROM s) SELECT qid, id, round(1 - (1 - sim), 3) score, CAST(k AS INTEGER) k FROM r WHERE k <= 8""")
def search_identified(spark, sf):
    """Unidentified voices and the chair are left out before the best are taken, so no search has to fetch more than it shows."""
    c = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    q = c.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    r = vec.knn(q, c.select("id", "vec", "label"), 8, ~F.col("label").isin(0, 7))
    return r.select("qid", "id", F.round("sim", 3).alias("score"), F.col("rank").alias("k"))


@query("""SELECT s_suppkey, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(upper(strip_accents(n)), '[-''.]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> 'I'), ' ') nombre
FROM (SELECT s_suppkey, 'Núñez-Feijóo i O''Neill, ' || s_name || '.' n FROM supplier)""".replace("\\\\", "\\"))
def registry_names(spark, sf):
    """Names as a registry writes them: capitals without marks, hyphens, apostrophes, dots and a lone I."""
    n = F.concat(F.lit("Núñez-Feijóo i O'Neill, "), "s_name", F.lit("."))
    words = F.split(tx.squeeze(F.regexp_replace(F.upper(tx.bare(n)), "[-'.]", "")), " ")
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(F.filter(words, lambda t: t != "I"), " ").alias("nombre"))


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Presidencia' WHEN 2 THEN '(miembro del Gobierno)' WHEN 3 THEN '(sin identificar)' WHEN 4 THEN 'Portavoz del Gobierno ' || c_custkey ELSE ' ' || c_name END n, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Gobierno' ELSE c_mktsegment END g FROM customer)
SELECT c_custkey, CASE WHEN n = '(miembro del Gobierno)' THEN 'Gobierno' WHEN n IN ('', '(sin identificar)') THEN 'Orador sin identificar' WHEN n = 'Presidencia' THEN n WHEN g = '' THEN trim(n) ELSE trim(n) || ' (' || g || ')' END etiqueta,
CASE WHEN n = 'Presidencia' THEN 'presidencia' WHEN g = 'Gobierno' OR contains(lower(n), 'gobierno') THEN 'gobierno' ELSE 'diputado' END rol FROM s""")
def speaker_labels(spark, sf):
    """What a speaker is called in the minutes, and the role that follows from name and party."""
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    n = F.when(m == 0, "").when(m == 1, "Presidencia").when(m == 2, "(miembro del Gobierno)").when(m == 3, "(sin identificar)").when(m == 4, F.concat(F.lit("Portavoz del Gobierno "), k)).otherwise(F.concat(F.lit(" "), "c_name"))
    g = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 7 == 1, "Gobierno").otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", rec.speaker_label(n, g).alias("etiqueta"), rec.role_of(n, g).alias("rol"))


@query(f"""WITH {SEG}, m AS (SELECT * FROM (VALUES ('view', 'Ana'), ('click', 'Luis'), ('error', 'Presidencia')) t(speaker, nombre)) SELECT pleno_id, seg_id, coalesce(nombre, seg.speaker) nombre, coalesce(nombre = 'Presidencia', false) mesa FROM seg LEFT JOIN m ON seg.speaker = m.speaker""")
def label_map(spark, sf):
    """Names given to voices; voices without one keep their label, and the chair's mark wins."""
    m = spark.createDataFrame([("view", "Ana"), ("click", "Luis"), ("error", "Presidencia")], "speaker string, nombre string")
    j = segments(spark, sf).join(m, "speaker", "left")
    return j.select("pleno_id", "seg_id", F.coalesce("nombre", "speaker").alias("nombre"), F.coalesce(F.col("nombre") == "Presidencia", F.lit(False)).alias("mesa"))


@query("""WITH a AS (SELECT user_id || '-' || CAST(floor(value) AS INTEGER) k, event_type || '-' || CAST(floor(value / 10) AS INTEGER) p FROM events), f AS (SELECT k, count(DISTINCT p) n FROM a GROUP BY 1), g AS (SELECT p, count(DISTINCT k) n FROM a GROUP BY 1)
SELECT (SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) FROM f) consistencia, (SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) FROM g) pureza""")
def voice_consistency(spark, sf):
    """Share of voices with one name, and of names with one voice."""
    v = F.col("value")
    a = table(spark, sf, "events").select(F.concat_ws("-", "user_id", F.floor(v)).alias("k"), F.concat_ws("-", "event_type", F.floor(v / 10)).alias("p"))
    share = lambda by, of, name: a.groupBy(by).agg(F.countDistinct(of).alias("n")).agg(F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias(name))
    return share("k", "p", "consistencia").crossJoin(share("p", "k", "pureza"))  # one row each


@query("""SELECT event_type modelo, count(*) n, round(sum(CASE WHEN value >= 60 THEN value ELSE 0 END) / sum(value), 6) identificado, round(sum(CASE WHEN value >= 30 AND value < 60 THEN value ELSE 0 END) / sum(value), 6) revisar, round(sum(CASE WHEN value < 30 THEN value ELSE 0 END) / sum(value), 6) mal, round(avg(value), 4) media FROM events GROUP BY 1""")
def voice_id_shares(spark, sf):
    """Seconds identified, to be reviewed and wrong as shares of all, and the mean by model."""
    v = F.col("value")
    share = lambda cond: F.round(F.sum(F.when(cond, v).otherwise(0.0)) / F.sum(v), 6)
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("modelo"))
    return g.agg(F.count(F.lit(1)).alias("n"), share(v >= 60).alias("identificado"), share((v >= 30) & (v < 60)).alias("revisar"), share(v < 30).alias("mal"), F.round(F.avg(v), 4).alias("media"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN value < 50 THEN NULL ELSE event_type END p FROM events) SELECT user_id, count(*) n, max(struct_pack(e := event_id, p := p)).p partido FROM e WHERE p IS NOT NULL GROUP BY 1""")
def roster_bootstrap(spark, sf):
    """A roster out of naming events: how often each was named, and its last party that is given."""
    e = table(spark, sf, "events").filter("value >= 50")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", "event_id").alias("partido"))


@query("""WITH m AS (SELECT c_custkey, lower(c_mktsegment) k FROM customer), r AS (SELECT DISTINCT lower(c_mktsegment) k FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey < 3)
SELECT c_custkey % 10 leg, count(*) faltan, count(r.k) recuperables, count(*) - count(r.k) quedan FROM m LEFT JOIN r ON m.k = r.k WHERE c_custkey % 3 = 0 GROUP BY 1""")
def registry_fill(spark, sf):
    """Rows without a party by term: how many the registry would fill, how many stay."""
    c = table(spark, sf, "customer").withColumn("k", F.lower("c_mktsegment"))
    r = c.filter("c_custkey % 2 = 0 and c_nationkey < 3").select("k").distinct().withColumn("hit", F.lit(1))
    g = c.filter("c_custkey % 3 = 0").join(r, "k", "left").groupBy((F.col("c_custkey") % 10).alias("leg")).agg(F.count(F.lit(1)).alias("faltan"), F.count("hit").alias("recuperables"))
    return g.withColumn("quedan", F.col("faltan") - F.col("recuperables"))


@query("""WITH e AS (SELECT vec_id id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings), s AS (SELECT y.id, max(list_sum(list_transform(range(1, 65), lambda i: x.v[i] * y.v[i]))) sim FROM e y, e x WHERE x.id % 10 = 0 AND y.id % 10 <> 0 GROUP BY 1)
SELECT id // 10 respuesta, round(avg(sim), 6) media, round(min(sim), 6) minimo, avg(sim) >= 0.25 AND min(sim) >= 0.15 fundada FROM s GROUP BY 1""")
def grounding(spark, sf):
    """An answer's sentences against the sources: their mean and least support."""
    c = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    best = vec.max_similarity(c.filter("id % 10 <> 0"), c.filter("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")))
    g = best.groupBy(F.floor(F.col("id") / 10).alias("respuesta")).agg(F.avg("sim").alias("m"), F.min("sim").alias("k"))
    return g.select("respuesta", F.round("m", 6).alias("media"), F.round("k", 6).alias("minimo"), ((F.col("m") >= 0.25) & (F.col("k") >= 0.15)).alias("fundada"))


@query("""WITH u AS (SELECT 'texto' tipo, page_id id, url titulo FROM pages UNION ALL SELECT 'video', conv_id * 100 + turn, role FROM conversations UNION ALL SELECT 'captura', item_id, left(text, 20) FROM benchmark) SELECT tipo, count(*) n, count(DISTINCT titulo) titulos, min(id) primero FROM u GROUP BY 1""")
def fragment_union(spark, sf):
    """Fragments of three kinds in one table, each with the columns it has."""
    p = table(spark, sf, "pages").select(F.lit("texto").alias("tipo"), F.col("page_id").alias("id"), F.col("url").alias("titulo"), "url")
    v = table(spark, sf, "conversations").select(F.lit("video").alias("tipo"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("titulo"), F.col("turn").alias("start"))
    b = table(spark, sf, "benchmark").select(F.lit("captura").alias("tipo"), F.col("item_id").alias("id"), F.left("text", F.lit(20)).alias("titulo"))
    u = p.unionByName(v, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return u.groupBy("tipo").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("titulo").alias("titulos"), F.min("id").alias("primero"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) l FROM documents), c AS (SELECT doc_id, left(trim(l), 50) k, min(length(l)) n FROM s WHERE regexp_matches(lower(l), '^(the|le|el|der|la|die) ') GROUP BY 1, 2) SELECT doc_id, count(*) puntos, CAST(max(least(n, 800)) AS BIGINT) largo FROM c GROUP BY 1""")
def agenda_cues(spark, sf):
    """Lines of a document that open with an article as titles do, one for each beginning of 50 characters, cut at 800; the record's own cues are in agenda_blind."""
    s = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).filter(F.rlike(F.lower("l"), F.lit("^(the|le|el|der|la|die) ")))
    c = s.groupBy("doc_id", F.left(F.trim("l"), F.lit(50)).alias("k")).agg(F.min(F.length("l")).alias("n"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("puntos"), F.max(F.least("n", F.lit(800))).cast("long").alias("largo"))


@query(f"""WITH {SEG} SELECT pleno_id, seg_id, CASE WHEN contains(t, 'votacion') AND contains(t, 'a favor') AND contains(t, 'en contra') THEN 'recuento' WHEN contains(t, 'votacion') THEN 'votacion' END evento
FROM (SELECT *, CASE seg_id % 4 WHEN 0 THEN 'votacion: votos a favor, en contra ' WHEN 1 THEN 'pasamos a la votacion ' ELSE '' END || speaker t FROM seg)""")
def vote_calls(spark, sf):
    """What each segment says of a vote: that it is counted, or called, or nothing; a count is looked for first."""
    said = F.when(F.col("seg_id") % 4 == 0, "votación: votos a favor, en contra ").when(F.col("seg_id") % 4 == 1, "pasamos a la votación ").otherwise("")
    s = segments(spark, sf).withColumn("t", tx.norm_key(F.concat(said, "speaker")))
    has = lambda w: F.contains("t", F.lit(w))
    return s.select("pleno_id", "seg_id", F.when(has("votacion") & has("a favor") & has("en contra"), "recuento").when(has("votacion"), "votacion").alias("evento"))


@query("""WITH d AS (SELECT o_custkey email, o_orderkey pleno, o_totalprice FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY pleno DESC) k FROM d), h AS (SELECT * FROM r WHERE k <= 3 AND o_totalprice > 200000) SELECT email, max(pleno) pleno FROM h GROUP BY 1""")
def welcome_message(spark, sf):
    """Of a new subscriber's three latest sessions the first that has something to tell."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return table(spark, sf, "orders").withColumn("k", k).filter("k <= 3 and o_totalprice > 200000").groupBy(F.col("o_custkey").alias("email")).agg(F.max("o_orderkey").alias("pleno"))


@query()
def literal_overlap(spark, sf):
    """Share of a version's words that stand in matching blocks with the official text: a text without every fifth word against itself."""
    d = table(spark, sf, "benchmark")
    d = d.withColumn("v", F.array_join(F.filter(F.split("text", " "), lambda x, i: i % 5 != 4), " "))
    return sequences.literal_share(d, "item_id", "text", "v").select("item_id", F.col("share").alias("comun"))


@query()
def announced_names(spark, sf):
    """Who is given the floor: the roster's name most like the words after 'palabra', names being written in many ways."""
    p = people(spark, sf)
    said = F.concat(F.lit("Gracias, señor presidente. Tiene la palabra el señor "), F.col("escrito"), F.lit(" por su grupo"))
    roster = p.filter("id % 2 = 0").groupBy(F.col("nombre").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.announced(p.select("id", said.alias("t")), "id", "t", roster).drop("partido")


@query("""WITH c AS (SELECT c_custkey, [c_name, c_mktsegment, 'X', 'Ana ' || c_custkey] pers, CASE c_custkey % 4 WHEN 0 THEN ['Estado', 'Grupo Popular'] WHEN 1 THEN ['Cámara', 'Gobierno de España'] WHEN 2 THEN ['Estado'] ELSE ['Estado', 'Coalición Canaria', 'VOX'] END orgs FROM customer)
SELECT c_custkey, (SELECT min_by(p, (-length(p), p)) FROM (SELECT unnest(pers) p) WHERE length(p) > 1) persona, CASE c_custkey % 4 WHEN 0 THEN 'Grupo Popular' WHEN 1 THEN 'Gobierno' WHEN 2 THEN '' ELSE 'Coalición Canaria' END partido, c_custkey % 4 <> 2 grupo FROM c""")
def ner_picks(spark, sf):
    """The person and the party of what a name finder found in a text."""
    k = F.col("c_custkey").cast("string")
    pers = F.array("c_name", "c_mktsegment", F.lit("X"), F.concat(F.lit("Ana "), k))
    m = F.col("c_custkey") % 4
    orgs = lambda *names: F.array(*[F.lit(n) for n in names])
    found = F.when(m == 0, orgs("Estado", "Grupo Popular")).when(m == 1, orgs("Cámara", "Gobierno de España")).when(m == 2, orgs("Estado")).otherwise(orgs("Estado", "Coalición Canaria", "VOX"))
    return table(spark, sf, "customer").select("c_custkey", rec.picked_person(pers).alias("persona"), rec.picked_party(found).alias("partido"), rec.is_real_group(found).alias("grupo"))


@query()
def speaker_accuracy(spark, sf):
    """A blind record against the official one, session by session: coverage, names, fidelity and topic, and their mean. Every sixth intervention is missing, every fourth has another name."""
    e = table(spark, sf, "embeddings")
    b = e.select(F.floor(F.col("vec_id") / 50).alias("pleno_id"), (F.col("vec_id") % 50).alias("pos"), F.concat(F.lit("Orador "), F.col("label").cast("string")).alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    a = b.filter("pos % 6 <> 5").withColumn("name", F.when(F.col("pos") % 4 == 3, F.lit("otro")).otherwise(F.col("name")))
    return sequences.compared(a, b)


@query(f"""WITH {SEG}, r AS (SELECT pleno_id, speaker || ':' || CAST(floor(start) AS BIGINT) || ':' || (seg_id % 5 = 0) x FROM seg) SELECT pleno_id, md5(string_agg(x, '|' ORDER BY x)) firma FROM r GROUP BY 1""")
def voice_signature(spark, sf):
    """The key under which a session's voiceprints are kept: speakers, whole seconds and overlaps. A session's segments are what one row gathers."""
    s = segments(spark, sf).select("pleno_id", F.concat_ws(":", "speaker", F.floor("start").cast("string"), (F.col("seg_id") % 5 == 0).cast("string")).alias("x"))
    return s.groupBy("pleno_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list("x")), "|")).alias("firma"))
