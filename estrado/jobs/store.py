"""Upserts, alerts and resolution over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import alerts, ingest, resolve, versions
from ..operators import upserts as up
from ..operators.components import scratch, written
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# The roster of a session: customers stand for members, nations for entities. Old rows are those of even keys, new ones those divisible by three.
OLD = "o AS (SELECT c_custkey id, c_mktsegment grupo, 'cargo' || c_nationkey cargo, 1 n, 'csv' fuente FROM customer WHERE c_custkey % 2 = 0)"
NEW = "w AS (SELECT c_custkey id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'G' || c_nationkey END grupo, 'X' cargo, 5 n, 'ner' fuente FROM customer WHERE c_custkey % 3 = 0)"


def _roster(spark, sf):
    c = table(spark, sf, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grupo"), F.concat(F.lit("cargo"), "c_nationkey").alias("cargo"), F.lit(1).alias("n"), F.lit("csv").alias("fuente"))
    grupo = F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.concat(F.lit("G"), "c_nationkey"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), grupo.alias("grupo"), F.lit("X").alias("cargo"), F.lit(5).alias("n"), F.lit("ner").alias("fuente"))
    return old, new


@query(f"""WITH {OLD}, {NEW} SELECT coalesce(o.id, w.id) id, CASE WHEN o.id IS NULL THEN w.grupo WHEN w.id IS NULL THEN o.grupo ELSE coalesce(nullif(w.grupo, ''), o.grupo) END grupo,
CASE WHEN o.id IS NULL THEN w.cargo ELSE o.cargo END cargo, coalesce(w.n, o.n) n, coalesce(w.fuente, o.fuente) fuente FROM o FULL JOIN w ON o.id = w.id""")
def upsert_coalesce(spark, sf):
    """A group stays unless the new one is given, count and source are the new ones, an office is never changed."""
    old, new = _roster(spark, sf)
    return up.upsert(old, new, ["id"], replace=["n", "fuente"], fill=["grupo"])


@query(f"""WITH {OLD}, {NEW} SELECT coalesce(o.id, w.id) id, coalesce(o.grupo, w.grupo) grupo, coalesce(w.cargo, o.cargo) cargo, coalesce(o.n, w.n) n, coalesce(o.fuente, w.fuente) fuente FROM o FULL JOIN w ON o.id = w.id""")
def upsert_subset(spark, sf):
    """A session's new row changes one column alone."""
    old, new = _roster(spark, sf)
    return up.upsert(old, new, ["id"], replace=["cargo"])


@query("""SELECT n_nationkey id, lower(n_name) slug, n_name nombre FROM nation UNION ALL SELECT 100 + s_nationkey, 'sup-' || s_nationkey, 'Supplier of ' || s_nationkey FROM (SELECT DISTINCT s_nationkey FROM supplier)""")
def upsert_entity(spark, sf):
    """Entities by slug: of many incoming rows with a new slug one is added."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("nombre"))
    s = table(spark, sf, "supplier")
    new = s.select((F.col("s_nationkey") + 100).alias("id"), F.concat(F.lit("sup-"), "s_nationkey").alias("slug"), F.concat(F.lit("Supplier of "), "s_nationkey").alias("nombre"), "s_suppkey")
    return up.upsert(n, up.latest(new, ["slug"], F.col("s_suppkey")).drop("s_suppkey"), ["slug"])


@query("SELECT o_orderkey id, CASE WHEN o_orderkey % 100 = 7 THEN 0.5 ELSE o_totalprice END fiabilidad FROM orders")
def point_update(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 100 == 7, 0.5).otherwise(F.col("o_totalprice")).alias("fiabilidad"))


@query(r"""WITH i AS (SELECT conv_id pleno_id, turn idx, text FROM conversations), o AS (SELECT * FROM i), w AS (SELECT pleno_id, idx, text || '!' text FROM i WHERE pleno_id % 3 = 0 AND idx < 3),
a AS (SELECT * FROM o WHERE pleno_id NOT IN (SELECT pleno_id FROM w) UNION ALL SELECT * FROM w)
SELECT pleno_id, idx, length(text) n_chars, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END n_words, left(text, 320) preview FROM a""")
def session_ingest(spark, sf):
    """A session that comes in again replaces all of its rows; counts and preview are derived."""
    i = table(spark, sf, "conversations").select(F.col("conv_id").alias("pleno_id"), F.col("turn").alias("idx"), "text")
    new = i.filter("pleno_id % 3 = 0 and idx < 3").withColumn("text", F.concat("text", F.lit("!")))
    a = up.replace_partition(i, new, ["pleno_id"])
    return a.select("pleno_id", "idx", F.length("text").cast("long").alias("n_chars"), tx.word_count(F.col("text")).cast("long").alias("n_words"), F.left("text", F.lit(320)).alias("preview"))


@query("SELECT CASE WHEN n_chars < 500 THEN 'captura' WHEN n_chars < 3000 THEN 'texto' ELSE 'video' END tipo, count(*) n FROM documents GROUP BY 1")
def rebuild_counts(spark, sf):
    kind = F.when(F.col("n_chars") < 500, "captura").when(F.col("n_chars") < 3000, "texto").otherwise("video")
    return table(spark, sf, "documents").groupBy(kind.alias("tipo")).agg(F.count(F.lit(1)).alias("n"))


SUBS = """s AS (SELECT c_custkey pos, 'u' || c_nationkey || '@x.es' email, CASE WHEN c_custkey % 11 = 0 THEN 'todos los plenos' ELSE lower(c_mktsegment) END tema, md5(c_name) token FROM customer)"""
FOUND = """f AS (SELECT o_orderkey % 40 pleno_id, lower(c_mktsegment) tema, o_orderkey chunk, round(o_totalprice, 2) sim FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000)"""
SEND = """tk AS (SELECT email, min(struct_pack(p := pos, t := token)).t token FROM s GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY pleno_id, tema ORDER BY sim DESC, chunk) k FROM f),
wi AS (SELECT DISTINCT email FROM s WHERE tema = 'todos los plenos'), na AS (SELECT DISTINCT email, tema FROM s WHERE tema <> 'todos los plenos' AND email NOT IN (SELECT email FROM wi)),
m AS (SELECT pleno_id, email, b.tema, chunk FROM na JOIN b ON na.tema = b.tema WHERE k <= 3 UNION ALL SELECT pleno_id, email, b.tema, chunk FROM wi, b WHERE k = 1), se AS (SELECT m.*, token FROM m JOIN tk ON m.email = tk.email)"""


def _send(spark, sf):
    c = table(spark, sf, "customer")
    tema = F.when(F.col("c_custkey") % 11 == 0, alerts.EVERYTHING).otherwise(F.lower("c_mktsegment"))
    subs = c.select(F.col("c_custkey").alias("pos"), F.concat(F.lit("u"), "c_nationkey", F.lit("@x.es")).alias("email"), tema.alias("tema"), F.md5("c_name").alias("token"))
    o = table(spark, sf, "orders").filter("o_totalprice > 300000")
    found = o.join(c, o.o_custkey == c.c_custkey).select((F.col("o_orderkey") % 40).alias("pleno_id"), F.lower("c_mktsegment").alias("tema"), F.col("o_orderkey").alias("chunk"), F.round("o_totalprice", 2).alias("sim"))
    return alerts.matches(subs, found)


@query(f"WITH {SUBS}, {FOUND}, {SEND} SELECT pleno_id, email, tema, chunk, token FROM se")
def alert_match(spark, sf):
    return _send(spark, sf).select("pleno_id", "email", "tema", "chunk", "token")


@query(f"""WITH {SUBS}, {FOUND}, {SEND}, g AS (SELECT pleno_id, email, string_agg(DISTINCT tema, '|' ORDER BY tema) temas, count(*) citas FROM se GROUP BY 1, 2) SELECT * FROM g WHERE NOT (pleno_id % 2 = 0 AND email LIKE 'u1%')""")
def alert_antidup(spark, sf):
    """One message for each session and address, unless one was sent."""
    g = _send(spark, sf).groupBy("pleno_id", "email").agg(F.array_join(F.sort_array(F.collect_set("tema")), "|").alias("temas"), F.count(F.lit(1)).alias("citas"))
    sent = g.filter("pleno_id % 2 = 0 and email like 'u1%'").select("pleno_id", "email")
    return up.not_yet(g, sent, ["pleno_id", "email"])


@query(f"""WITH {SUBS}, l AS (SELECT *, row_number() OVER (PARTITION BY email, tema ORDER BY pos DESC) k, min(pos) OVER (PARTITION BY email, tema) p FROM s) SELECT email, tema, token, p % 2 = 0 confirmado FROM l WHERE k = 1""")
def subscription_upsert(spark, sf):
    """Subscribing again replaces the token; whether it was confirmed stays."""
    c = table(spark, sf, "customer")
    tema = F.when(F.col("c_custkey") % 11 == 0, alerts.EVERYTHING).otherwise(F.lower("c_mktsegment"))
    s = c.select(F.col("c_custkey").alias("pos"), F.concat(F.lit("u"), "c_nationkey", F.lit("@x.es")).alias("email"), tema.alias("tema"), F.md5("c_name").alias("token"))
    old = up.latest(s, ["email", "tema"], F.col("pos")).select("email", "tema", "token", (F.col("pos") % 2 == 0).alias("confirmado"))
    new = up.latest(s, ["email", "tema"], F.desc("pos")).select("email", "tema", "token", F.lit(False).alias("confirmado"))
    return up.upsert(old, new, ["email", "tema"], replace=["token"])


@query("""WITH s AS (SELECT c_custkey, c_nationkey % 2 = 0 conf, c_custkey % 3 = 0 pide, c_custkey % 10 = 0 baja FROM customer) SELECT c_custkey, conf OR pide confirmado, pide AND NOT conf contada FROM s WHERE NOT baja""")
def confirm_and_leave(spark, sf):
    conf, ask = F.col("c_nationkey") % 2 == 0, F.col("c_custkey") % 3 == 0
    return table(spark, sf, "customer").filter("c_custkey % 10 <> 0").select("c_custkey", (conf | ask).alias("confirmado"), (ask & ~conf).alias("contada"))


@query("""WITH m AS (SELECT n_nationkey id, n_regionkey r, count(c_custkey) n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2), b AS (SELECT r, max(struct_pack(n := n, i := -id)) x FROM m GROUP BY 1)
SELECT c_custkey, -x.i entidad FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN b ON n_regionkey = r""")
def consolidate(spark, sf):
    """Entities that are one are joined into that with the most sessions, and their rows point to it."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    count = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    m = n.join(count, "n_nationkey", "left").select("n_nationkey", "n_regionkey", F.coalesce("k", F.lit(0)).alias("k"))
    best = m.groupBy("n_regionkey").agg(F.max(F.struct("k", (-F.col("n_nationkey")).alias("i"))).alias("x"))
    to = n.join(best, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), (-F.col("x.i")).alias("entidad"))
    return c.join(F.broadcast(to), "c_nationkey").select("c_custkey", "entidad")  # 25 nations


@query("""WITH g AS (SELECT p_brand orador, p_size % 5 leg, count(DISTINCT p_type) n FROM part GROUP BY 1, 2), h AS (SELECT orador, leg, 'M' || leg correcto FROM g WHERE leg < 2 UNION ALL SELECT 'Ido', 9, 'viejo')
SELECT coalesce(g.orador, h.orador) orador, coalesce(g.leg, h.leg) leg, coalesce(g.n, 0) n, coalesce(h.correcto, '') correcto FROM g FULL JOIN h ON g.orador = h.orador AND g.leg = h.leg""")
def review_upsert(spark, sf):
    """A review table is made anew, but what people wrote in it stays."""
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("orador"), (F.col("p_size") % 5).alias("leg")).agg(F.countDistinct("p_type").alias("n"))
    human = g.filter("leg < 2").select("orador", "leg", F.lit(0).cast("long").alias("n"), F.concat(F.lit("M"), "leg").alias("correcto"))
    human = human.union(spark.createDataFrame([("Ido", 9, 0, "viejo")], human.schema))
    return up.upsert(human, g.withColumn("correcto", F.lit("")), ["orador", "leg"], replace=["n"], fill=["correcto"])


@query("SELECT event_type manual, count(*) total, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) utiles, CASE WHEN count(*) > 0 THEN round(100.0 * sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 1) END pct FROM events GROUP BY 1".replace("sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) utiles", "CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) utiles"))
def feedback_totals(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("manual")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 50).alias("utiles"))
    return g.withColumn("pct", F.when(F.col("total") > 0, F.round(100 * F.col("utiles") / F.col("total"), 1)))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 30")
def outbox_latest(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'purchase'").orderBy(F.desc("event_id")).limit(30).select("event_id", "user_id", "event_type")


@query("""SELECT c_custkey, lower(trim(e)) email FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' U' || c_custkey || '@X.es ' WHEN 1 THEN 'u@x' ELSE 'nadie' END e, lower(c_mktsegment) tema FROM customer)
WHERE regexp_matches(lower(trim(e)), '^[^@]+@[^@]*\\.[^@]*$') AND tema IN (SELECT DISTINCT lower(c_mktsegment) FROM customer WHERE c_custkey < 3)""".replace("\\\\", "\\"))
def subscribe_checks(spark, sf):
    """A well-formed address and a topic of the closed catalogue."""
    c = table(spark, sf, "customer")
    m = F.col("c_custkey") % 3
    e = F.lower(F.trim(F.when(m == 0, F.concat(F.lit(" U"), F.col("c_custkey").cast("string"), F.lit("@X.es "))).when(m == 1, "u@x").otherwise("nadie")))
    topics = c.filter("c_custkey < 3").select("c_mktsegment").distinct()
    return c.join(topics, "c_mktsegment", "left_semi").select("c_custkey", e.alias("email")).filter(F.rlike("email", F.lit(r"^[^@]+@[^@]*\.[^@]*$")))


@query("""WITH q AS (SELECT p_partkey qid, unnest(list_distinct(string_split(lower(p_name), ' '))) w FROM part WHERE p_partkey % 20 = 0), k AS (SELECT lower(p_type) k, count(*) n FROM part GROUP BY 1),
h AS (SELECT qid, k, any_value(n) n, count(*) hits FROM q JOIN k ON length(w) >= 3 AND contains(k, w) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY hits DESC, n DESC, k) AS INTEGER) rank FROM h) SELECT qid, k AS key, hits, n, rank FROM r""")
def token_hit_resolve(spark, sf):
    p = table(spark, sf, "part")
    q = p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), F.lower("p_name").alias("q"))
    s = p.groupBy(F.lower("p_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    h = resolve.by_token_hits(q, s)
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), F.desc("n"), "key"))).select("qid", "key", "hits", "n", "rank")


NAMES = """n AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN replace(s_name, '#', '') WHEN 2 THEN left(s_name, 8) ELSE s_name || 'xyz' END AS name FROM supplier), r AS (SELECT DISTINCT s_name canon FROM supplier)"""


@query(f"""WITH {NAMES}, e AS (SELECT name, canon, 1 via FROM n JOIN r ON name = canon), t AS (SELECT name, min(canon) canon, 2 via FROM n JOIN r ON replace(name, ' ', '') = replace(canon, ' ', '') GROUP BY 1),
d AS (SELECT name, min(canon) canon, 3 via FROM n JOIN r ON levenshtein(name, canon) <= 1 GROUP BY 1 HAVING count(*) = 1), p AS (SELECT name, min(canon) canon, 4 via FROM n JOIN r ON length(name) >= 6 AND starts_with(canon, name) GROUP BY 1 HAVING count(*) = 1),
u AS (SELECT * FROM e UNION ALL SELECT * FROM t UNION ALL SELECT * FROM d UNION ALL SELECT * FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY via) k FROM u) SELECT n.name, canon, via FROM n LEFT JOIN k ON n.name = k.name AND k.k = 1""")
def cascade_lookup(spark, sf):
    s = table(spark, sf, "supplier")
    m = F.col("s_suppkey") % 4
    name = F.when(m == 0, F.col("s_name")).when(m == 1, F.replace("s_name", F.lit("#"), F.lit(""))).when(m == 2, F.left("s_name", F.lit(8))).otherwise(F.concat("s_name", F.lit("xyz")))
    return resolve.cascade(s.select(name.alias("name")), s.select(F.col("s_name").alias("canon")))


@query("""WITH q AS (SELECT p_partkey qid, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Brand' END q FROM part WHERE p_partkey % 10 = 0), k AS (SELECT p_brand b, count(*) n FROM part GROUP BY 1),
s AS (SELECT qid, q, b, CASE WHEN contains(lower(b), lower(q)) THEN 100 ELSE 0 END score, n FROM q, k), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, n DESC, b) k FROM s WHERE score > 0)
SELECT q.qid, coalesce((SELECT min(b) FROM k WHERE b = q.q), r.b, q.q) partido FROM q LEFT JOIN r ON q.qid = r.qid AND r.k = 1""")
def party_resolve(spark, sf):
    """A party by its canonical name, else the largest whose name holds what was asked, else as asked."""
    p = table(spark, sf, "part")
    q = p.filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("Brand").alias("q"))
    k = p.groupBy(F.col("p_brand").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = resolve.holding(q.select("q").distinct(), k.withColumnRenamed("b", "label")).withColumnRenamed("label", "b")
    best = best.groupBy("q").agg(F.max(F.struct((F.col("b") == F.col("q")).alias("same"), "n", F.translate("b", "0123456789", "9876543210").alias("z"), "b")).alias("m"))
    return q.join(best, "q", "left").select("qid", F.coalesce("m.b", "q").alias("partido"))


@query("""WITH a AS (SELECT label, vec_id % 50 v FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT label, vec_id % 50 v FROM embeddings WHERE vec_id % 2 = 1 OR vec_id < 200),
x AS (SELECT DISTINCT label, v FROM a), y AS (SELECT DISTINCT label, v FROM b) SELECT x.label, count(*) n, count(y.v) comunes, round(count(y.v) * 1.0 / count(*), 6) recall FROM x LEFT JOIN y ON x.label = y.label AND x.v = y.v GROUP BY 1""")
def set_recall(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 50).alias("v"), "vec_id")
    x, y = e.filter("vec_id % 2 = 0").select("label", "v").distinct(), e.filter("vec_id % 2 = 1 or vec_id < 200").select("label", "v").distinct().withColumn("hit", F.lit(1))
    g = x.join(y, ["label", "v"], "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("comunes"))
    return g.withColumn("recall", F.round(F.col("comunes") / F.col("n"), 6))


@query(r"""SELECT s_suppkey, nullif(regexp_extract(substr(t, strpos(t, s_name), 250), 'Grupo ([A-Z]\w+)', 1), '') grupo FROM (SELECT s_suppkey, s_name, 'Interviene ' || s_name || repeat(' bla', CAST(s_suppkey % 90 AS INTEGER)) || ' del Grupo Mixto.' t FROM supplier)""")
def nearest_mention(spark, sf):
    """The group named within 250 characters after a name."""
    t = F.concat(F.lit("Interviene "), "s_name", F.repeat(F.lit(" bla"), (F.col("s_suppkey") % 90).cast("int")), F.lit(" del Grupo Mixto."))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", t.alias("t"))
    near = F.substr(F.col("t"), F.position(F.col("s_name"), F.col("t")), F.lit(250))
    return s.select("s_suppkey", F.nullif(F.regexp_extract(near, r"Grupo ([A-Z]\w+)", 1), F.lit("")).alias("grupo"))


@query("""WITH a AS (SELECT l_suppkey s, l_returnflag p, l_linestatus c FROM lineitem WHERE l_quantity >= 40), n AS (SELECT s, p, count(*) n FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, p) k FROM n)
SELECT s, p partido, n, (SELECT count(DISTINCT c) FROM a WHERE a.s = r.s) cargos FROM r WHERE k = 1""")
def government_roster(spark, sf):
    """Of each name its most frequent party and how many offices it held."""
    a = table(spark, sf, "lineitem").filter("l_quantity >= 40").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_linestatus").alias("c"))
    n = a.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "p"))
    top = n.withColumn("k", k).filter("k = 1").select("s", F.col("p").alias("partido"), "n")
    return top.join(a.groupBy("s").agg(F.countDistinct("c").alias("cargos")), "s")


@query("""WITH c AS (SELECT conv_id pleno_id, count(*) n, sum(length(text)) chars FROM conversations GROUP BY 1)
SELECT pleno_id, CASE WHEN pleno_id % 3 = 0 THEN '2024-02-02' ELSE '2024-01-01' END fecha, true filas, true vectores, n trozos, CASE WHEN pleno_id % 2 = 0 THEN 1 ELSE 2 END pasada FROM c""")
def two_phase_ingest(spark, sf):
    """An ingest that is cut off in its second phase and resumed: each session's vectors are made once, and a header that comes again leaves the flags."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("pleno_id"), F.col("turn").alias("idx"), "text")
    ids = c.select("pleno_id").distinct()
    all_, cut = F.lit(True), F.col("pleno_id") % 2 == 0
    state = spark.createDataFrame([], "pleno_id long, fecha string, filas boolean, vectores boolean")
    rows = spark.createDataFrame([], "pleno_id long, idx long, text string")
    chunks = spark.createDataFrame([], "pleno_id long, idx long, pasada int")
    made = lambda n: c.select("pleno_id", F.col("idx").cast("long").alias("idx"), F.lit(n).alias("pasada"))
    state = ingest.register(state, ids.withColumn("fecha", F.lit("2024-01-01")))
    state, rows = ingest.run(state, rows, c.withColumn("idx", F.col("idx").cast("long")), "filas", all_)
    state, chunks = ingest.run(state, chunks, made(1), "vectores", cut)
    state, chunks = written(state, "state"), written(chunks, "chunks")
    state = ingest.register(state, ids.filter("pleno_id % 3 = 0").withColumn("fecha", F.lit("2024-02-02")))
    state, chunks = ingest.run(state, chunks, made(2), "vectores", all_)
    n = chunks.groupBy("pleno_id").agg(F.count(F.lit(1)).alias("trozos"), F.max("pasada").alias("pasada"))
    return state.join(n, "pleno_id", "left")


@query("""WITH m AS (SELECT n_nationkey id, n_regionkey r, lower(r_name) short, CASE WHEN n_nationkey IN (7, 21) THEN lower(r_name) ELSE lower(n_name) END slug, count(c_custkey) n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2, 3, 4), b AS (SELECT r, max(struct_pack(s := slug = short, n := n, i := -id)) x FROM m GROUP BY 1), t AS (SELECT m.id, -b.x.i AS a, m.short slug FROM m JOIN b ON m.r = b.r),
k AS (SELECT a entidad, slug, c_mktsegment tema, c_custkey, row_number() OVER (PARTITION BY a, c_mktsegment ORDER BY c_nationkey <> a, c_custkey) o FROM customer JOIN t ON c_nationkey = id) SELECT entidad, slug, tema, c_custkey FROM k WHERE o = 1""")
def consolidate_children(spark, sf):
    """Nations of one region are one: the one that bears the region's short slug stays, else that with most sessions, and has the short slug; of rows that then clash the entity's own stays, else the first."""
    n, c = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")), table(spark, sf, "customer")
    short = F.lower("r_name")
    entities = n.join(c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k")), "n_nationkey", "left").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("same"), F.when(F.col("n_nationkey").isin(7, 21), short).otherwise(F.lower("n_name")).alias("slug"), short.alias("short"), F.coalesce("k", F.lit(0)).alias("n"))
    children = c.select(F.col("c_nationkey").alias("entidad"), F.col("c_mktsegment").alias("tema"), "c_custkey")
    return up.consolidated(entities, children, ["tema"], "c_custkey").select("entidad", "slug", "tema", "c_custkey")


@query("""SELECT conv_id pleno_id, true filas, true vectores, count(*) trozos, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END pasada FROM conversations GROUP BY 1""")
def versioned_ingest(spark, sf):
    """The same ingest in tables with versions: each phase's rows and flags appear in one step. A run dies in its second phase, once in the middle and once with its rows written and no version made; then it is resumed."""
    root = scratch(spark, "store")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("pleno_id"), F.col("turn").cast("long").alias("idx"), "text")
    now = lambda t: versions.read(spark, root, t)
    flags = lambda ids, vectors: ids.select("pleno_id", F.lit(True).alias("filas"), F.lit(vectors).alias("vectores"))
    made = lambda ids, n: c.join(ids, "pleno_id", "left_semi").select("pleno_id", "idx", F.lit(n).alias("pasada"))
    all_ = c.select("pleno_id").distinct()
    versions.change(spark, root, {"rows": (c, ["pleno_id"]), "state": (flags(all_, False), ["pleno_id"])})
    half = now("state").filter("not vectores and pleno_id % 2 = 0").select("pleno_id")
    versions.change(spark, root, {"chunks": (made(half, 1), ["pleno_id"]), "state": (flags(half, True), ["pleno_id"])})
    # rows of the rest are written, and the run dies before they are published
    left = now("state").filter("not vectores").select("pleno_id")
    versions.prepare(spark, root, "chunks", made(left, -1), ["pleno_id"], versions.manifest(spark, root))
    # resumed
    left = now("state").filter("not vectores").select("pleno_id")
    versions.change(spark, root, {"chunks": (made(left, 2), ["pleno_id"]), "state": (flags(left, True), ["pleno_id"])})
    n = now("chunks").groupBy("pleno_id").agg(F.count(F.lit(1)).alias("trozos"), F.max("pasada").alias("pasada"))
    return now("state").join(n, "pleno_id", "left").select("pleno_id", "filas", "vectores", "trozos", "pasada")
