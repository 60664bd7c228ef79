"""Retrieval, topics, voices and axes over the given embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vector import dot, mean_vector, unit
from ..operators import index
from ..operators import vectors as op
from ..operators.components import scratch
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


#: Least likeness and margin of a match, set for how alike these 64-dimensional vectors are.
MATCH = (0.25, 0.03)
DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"
E = "e AS (SELECT vec_id id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings)"
CENT = """d AS (SELECT label, i, avg(v[i]) m FROM e, (SELECT unnest(range(1, 65)) i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) l FROM d GROUP BY 1),
c AS (SELECT d.label, list(m / l ORDER BY i) cv FROM d JOIN n ON d.label = n.label GROUP BY 1)"""


def chunks(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def asked(c, every: int):
    return c.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def centroids(c):
    return mean_vector(c, ["label"], "vec").select("label", unit(F.col("centroid")).alias("cv"))


@query(f"""WITH {E}, s AS (SELECT q.id qid, e.id, {DOT.format("q.v", "e.v")} sim FROM e q, e WHERE q.id % 20 = 0 AND e.label IN (1, 3, 5)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS INTEGER) rank FROM s) SELECT qid, id, round(sim, 6) sim, rank FROM r WHERE rank <= 8""")
def knn_filtered(spark, sf):
    c = chunks(spark, sf)
    return op.knn(asked(c, 20), c.select("id", "label", "vec"), 8, F.col("label").isin(1, 3, 5)).select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


@query(f"""WITH {E}, s AS (SELECT q.id qid, e.id, {DOT.format("q.v", "e.v")} sim FROM e q, e WHERE q.id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS INTEGER) rank FROM s) SELECT qid, id, round(sim, 6) sim, rank FROM r WHERE rank <= 5""")
def knn_batch_topk(spark, sf):
    c = chunks(spark, sf)
    return op.knn(asked(c, 20), c.select("id", "vec"), 5).select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {E}, {CENT} SELECT label, list_transform(cv, lambda x: round(x, 6)) centroid FROM c")
def topic_centroids(spark, sf):
    return centroids(chunks(spark, sf)).select("label", F.transform("cv", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"""WITH {E}, {CENT}, s AS (SELECT c.label tema, e.id, round({DOT.format("c.cv", "e.v")}, 6) sim FROM c, e), f AS (SELECT * FROM s WHERE sim >= 0.30),
r AS (SELECT *, row_number() OVER (PARTITION BY tema ORDER BY sim DESC, id) k FROM f) SELECT tema, max(sim) mejor, count(*) n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) FILTER (k <= 3) citas FROM r GROUP BY 1""")
def topic_detect(spark, sf):
    """Topics that some chunk reaches, with its three best chunks in their own order."""
    c = chunks(spark, sf)
    s = op.against(c.select("id", "vec"), centroids(c)).select(F.col("label").alias("tema"), "id", F.round(dot("cv", "vec"), 6).alias("sim")).filter("sim >= 0.30")
    k = F.row_number().over(Window.partitionBy("tema").orderBy(F.desc("sim"), "id"))
    cites = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= 3, F.col("id")))), lambda x: x.cast("string")), "|")
    return s.withColumn("k", k).groupBy("tema").agg(F.max("sim").alias("mejor"), F.count(F.lit(1)).alias("n"), cites.alias("citas"))


#: Axes as pairs of labels: the poles are their centroids, the subject lies between.
AXES = [(0, 0, 1), (1, 2, 3), (2, 4, 5)]


@query(f"""WITH {E}, {CENT}, a AS (SELECT eje, l.cv lv, r.cv rv FROM (VALUES (0, 0, 1), (1, 2, 3), (2, 4, 5)) x(eje, a, b) JOIN c l ON l.label = a JOIN c r ON r.label = b),
u AS (SELECT eje, list_transform(range(1, 65), lambda i: rv[i] - lv[i]) dv, list_transform(range(1, 65), lambda i: rv[i] + lv[i]) sv, lv, rv FROM a),
w AS (SELECT eje, list_transform(dv, lambda x: x / sqrt({DOT.format("dv", "dv")})) dv, list_transform(sv, lambda x: x / sqrt({DOT.format("sv", "sv")})) sv, lv, rv FROM u),
m AS (SELECT eje, dv, sv, ({DOT.format("lv", "dv")} + {DOT.format("rv", "dv")}) / 2 mid, ({DOT.format("rv", "dv")} - {DOT.format("lv", "dv")}) / 2 half FROM w),
s AS (SELECT e.label grupo, eje, e.id, {DOT.format("sv", "v")} sim, {DOT.format("v", "dv")} proj, mid, half FROM e, m),
r AS (SELECT *, row_number() OVER (PARTITION BY grupo, eje ORDER BY sim DESC, id) k FROM s),
g AS (SELECT grupo, eje, count(*) n, sum(sim * proj) / sum(sim) p, any_value(mid) mid, any_value(half) half, min(struct_pack(a := proj, b := id)).b evid_min, min(struct_pack(a := -proj, b := id)).b evid_max FROM r WHERE k <= 80 AND sim >= 0.20 GROUP BY 1, 2)
SELECT grupo, CAST(eje AS INTEGER) eje, n, CASE WHEN n >= 3 THEN round(greatest(-1.0, least(1.0, (p - mid) / half)), 3) END score, CASE WHEN n < 3 THEN 'sin_datos' WHEN n >= 20 THEN 'alta' WHEN n >= 8 THEN 'media' ELSE 'baja' END confianza, evid_min, evid_max FROM g""")
def axis_positions(spark, sf):
    c = chunks(spark, sf)
    return op.positions(c.select("id", F.col("label").alias("grupo"), "vec"), _axes(spark, c))


def _axes(spark, c):
    """(eje, subject, direction, mid, half) of the few axes."""
    cent = centroids(c)
    a = spark.createDataFrame(AXES, "eje int, a int, b int")
    a = a.join(cent.select(F.col("label").alias("a"), F.col("cv").alias("lv")), "a").join(cent.select(F.col("label").alias("b"), F.col("cv").alias("rv")), "b")
    a = a.withColumn("direction", unit(F.zip_with("rv", "lv", lambda x, y: x - y))).withColumn("subject", unit(F.zip_with("rv", "lv", lambda x, y: x + y)))
    lo, hi = dot("lv", "direction"), dot("rv", "direction")
    return a.select("eje", "subject", "direction", ((lo + hi) / 2).alias("mid"), ((hi - lo) / 2).alias("half"))


@query(f"""WITH {E}, {CENT}, a AS (SELECT eje, l.cv lv, r.cv rv FROM (VALUES (0, 0, 1), (1, 2, 3), (2, 4, 5)) x(eje, a, b) JOIN c l ON l.label = a JOIN c r ON r.label = b), u AS (SELECT eje, list_transform(range(1, 65), lambda i: rv[i] - lv[i]) dv, lv, rv FROM a),
w AS (SELECT eje, list_transform(dv, lambda x: x / sqrt({DOT.format("dv", "dv")})) dv, lv, rv FROM u), m AS (SELECT eje, dv, ({DOT.format("lv", "dv")} + {DOT.format("rv", "dv")}) / 2 mid, ({DOT.format("rv", "dv")} - {DOT.format("lv", "dv")}) / 2 half FROM w)
SELECT e.id, CAST(eje AS INTEGER) eje, round(greatest(-1.0, least(1.0, ({DOT.format("v", "dv")} - mid) / half)), 4) posicion FROM e, m WHERE e.id % 20 = 0""")
def axis_texts(spark, sf):
    """Where texts of one's own (every twentieth) stand on each axis, from -1 to 1."""
    c = chunks(spark, sf)
    j = op.against(asked(c, 20), _axes(spark, c).select("eje", "direction", "mid", "half"))
    at = (dot("qvec", "direction") - F.col("mid")) / F.col("half")
    return j.select(F.col("qid").alias("id"), "eje", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at)), 4).alias("posicion"))


PEOPLE = f"""x AS (SELECT id, label persona, v FROM e WHERE id % 20 <> 0), q AS (SELECT id qid, v FROM e WHERE id % 20 = 0),
s AS (SELECT qid, persona, max({DOT.format("q.v", "x.v")}) sim FROM q, x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, persona) k FROM s),
t AS (SELECT qid, max(persona) FILTER (k = 1) persona, max(sim) FILTER (k = 1) s1, coalesce(max(sim) FILTER (k = 2), 0) s2 FROM r GROUP BY 1)"""


def _two(spark, sf):
    c = chunks(spark, sf)
    return op.best_two(asked(c, 20), c.filter("id % 20 <> 0").select(F.col("label").alias("persona"), F.col("vec").alias("evec")))


@query(f"WITH {E}, {PEOPLE} SELECT qid, CASE WHEN s1 >= 0.3 THEN 'p' || persona ELSE '(desconocido)' END quien, round(s1, 6) sim FROM t")
def identify_openset(spark, sf):
    who = F.when(F.col("s1") >= 0.3, F.concat(F.lit("p"), F.col("persona"))).otherwise("(desconocido)")
    return _two(spark, sf).select("qid", who.alias("quien"), F.round("s1", 6).alias("sim"))


@query(f"WITH {E}, {PEOPLE} SELECT qid, CASE WHEN s1 >= 0.25 AND s1 - s2 >= 0.03 THEN persona END persona, round(s1, 6) s1, round(s2, 6) s2 FROM t")
def match_margin(spark, sf):
    t = op.with_margin(_two(spark, sf), *MATCH)
    return t.select("qid", "persona", F.round("s1", 6).alias("s1"), F.round("s2", 6).alias("s2"))


@query(f"""WITH {E}, {PEOPLE}, m AS (SELECT qid, qid // 20 % 12 voz, 1.0 + qid // 20 % 5 dur, CASE WHEN s1 >= 0.25 AND s1 - s2 >= 0.03 THEN persona END persona FROM t),
h AS (SELECT voz, persona, sum(dur) s FROM m WHERE persona IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, s / sum(s) OVER (PARTITION BY voz) cuota, row_number() OVER (PARTITION BY voz ORDER BY s DESC, persona) k FROM h)
SELECT m.qid, CASE WHEN k.cuota >= 0.80 THEN k.persona ELSE m.persona END persona FROM m LEFT JOIN k ON m.voz = k.voz AND k.k = 1""")
def supervised_assign(spark, sf):
    """A voice whose matched seconds belong to one person by 80 % is that person's whole; else only its matched segments are."""
    m = op.with_margin(_two(spark, sf), *MATCH).select("qid", (F.floor(F.col("qid") / 20) % 12).alias("voz"), (1.0 + F.floor(F.col("qid") / 20) % 5).alias("dur"), "persona")
    h = m.filter("persona is not null").groupBy("voz", "persona").agg(F.sum("dur").alias("s"))
    w = Window.partitionBy("voz")
    k = h.withColumn("cuota", F.col("s") / F.sum("s").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("s"), "persona"))).filter("k = 1")
    k = k.select("voz", F.col("persona").alias("jefe"), "cuota")
    return m.join(k, "voz", "left").select("qid", F.when(F.col("cuota") >= 0.80, F.col("jefe")).otherwise(F.col("persona")).alias("persona"))


@query(f"""WITH {E}, x AS (SELECT id qid, v FROM e WHERE id % 10 = 0), y AS (SELECT id, label, v FROM e WHERE id % 10 <> 0), s AS (SELECT id, any_value(label) label, max({DOT.format("x.v", "y.v")}) sim FROM y, x GROUP BY 1)
SELECT label, count(*) n, count(*) FILTER (sim >= 0.6) cubiertos, round(avg(CASE WHEN sim >= 0.6 THEN 1.0 ELSE 0.0 END), 6) cobertura, round(avg(sim), 6) media FROM s GROUP BY 1""")
def max_sim_coverage(spark, sf):
    """How much of each label lies near some source: the faithfulness of claims and the coverage of chapters."""
    c = chunks(spark, sf)
    best = op.max_similarity(c.filter("id % 10 <> 0").select("id", "vec"), asked(c, 10)).join(c.select("id", "label"), "id")
    ok = F.col("sim") >= 0.6
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("cubiertos"), F.round(F.avg(ok.cast("double")), 6).alias("cobertura"), F.round(F.avg("sim"), 6).alias("media"))


@query(f"""WITH {E}, s AS (SELECT q.id qid, e.id, {DOT.format("q.v", "e.v")} sim FROM e q, e WHERE q.id % 20 = 0 AND e.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) k FROM s)
SELECT qid, string_agg('c' || id, ' ' ORDER BY k) premisa FROM r WHERE k <= 4 GROUP BY 1""")
def premise_topk(spark, sf):
    """The four nearest sources of each claim as one premise, nearest first."""
    c = chunks(spark, sf)
    r = op.k_best(op.packed(asked(c, 20), "qid", "qvec"), op.packed(c, "id", "vec"), 4, others=True)
    p = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: F.concat(F.lit("c"), x["id"]))
    return r.groupBy("qid").agg(F.array_join(p, " ").alias("premisa"))


@query(f"""WITH {E}, s AS (SELECT label, id, {DOT.format("v", "lag(v) OVER (PARTITION BY label ORDER BY id)")} sim FROM e), t AS (SELECT *, avg(sim) OVER (PARTITION BY label) m, stddev_pop(sim) OVER (PARTITION BY label) d FROM s)
SELECT label, id, round(sim, 6) sim, sim < m - 0.9 * d corte FROM t WHERE sim IS NOT NULL""".replace("list_sum(list_transform(range(1, 65), lambda i: v[i] * lag(v) OVER (PARTITION BY label ORDER BY id)[i]))", "list_dot_product(v, p)").replace("FROM e), t", "FROM (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY id) p FROM e)), t"))
def semantic_cuts(spark, sf):
    """A cut where neighbours are less alike than the mean by 0.9 deviations."""
    w = Window.partitionBy("label").orderBy("id")
    s = chunks(spark, sf).withColumn("p", F.lag("vec").over(w)).filter("p is not null").select("label", "id", dot("vec", "p").alias("sim"))
    all_ = Window.partitionBy("label")
    return s.select("label", "id", F.round("sim", 6).alias("sim"), (F.col("sim") < F.avg("sim").over(all_) - 0.9 * F.stddev_pop("sim").over(all_)).alias("corte"))


@query(f"WITH {E} SELECT a.label, round(avg({DOT.format('a.v', 'b.v')}), 6) coseno FROM e a JOIN e b ON a.label = b.label AND a.id < b.id GROUP BY 1")
def intra_topic_cosine(spark, sf):
    """The mean cosine of all pairs of a label, from the sum of its vectors: (|sum|^2 - sum of |v|^2) / (n (n - 1)). No pair is made."""
    c = chunks(spark, sf)
    total = mean_vector(c, ["label"], "vec")
    n = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(dot("vec", "vec")).alias("own"))
    j = total.join(n, "label").filter("n > 1")
    return j.select("label", F.round((dot("centroid", "centroid") * F.col("n") * F.col("n") - F.col("own")) / (F.col("n") * (F.col("n") - 1)), 6).alias("coseno"))


@query(f"""WITH {E}, {CENT}, o AS (SELECT a.label, max({DOT.format("a.cv", "b.cv")}) otra FROM c a JOIN c b ON a.label <> b.label GROUP BY 1),
i AS (SELECT a.label, avg({DOT.format("a.v", "b.v")}) propia FROM e a JOIN e b ON a.label = b.label AND a.id < b.id GROUP BY 1)
SELECT o.label, round(propia, 6) propia, round(otra, 6) otra, CASE WHEN propia >= 0.60 THEN 'alta' WHEN propia >= 0.50 THEN 'media' ELSE 'baja' END nivel, otra >= 0.55 aviso FROM o JOIN i ON o.label = i.label""")
def voice_clarity(spark, sf):
    """How alike a voice's exemplars are, and how near the next voice is."""
    c = chunks(spark, sf)
    cent = centroids(c)
    other = op.against(cent, cent.select(F.col("label").alias("l2"), F.col("cv").alias("qvec"))).filter("label <> l2").groupBy("label").agg(F.max(dot("cv", "qvec")).alias("otra"))
    n = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(dot("vec", "vec")).alias("own"))
    own = mean_vector(c, ["label"], "vec").join(n, "label").select("label", ((dot("centroid", "centroid") * F.col("n") * F.col("n") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("propia"))
    level = F.when(F.col("propia") >= 0.60, "alta").when(F.col("propia") >= 0.50, "media").otherwise("baja")
    return own.join(other, "label").select("label", F.round("propia", 6).alias("propia"), F.round("otra", 6).alias("otra"), level.alias("nivel"), (F.col("otra") >= 0.55).alias("aviso"))


@query(f"""WITH {E}, s AS (SELECT q.id qid, q.label ql, e.label el, e.id, {DOT.format("q.v", "e.v")} sim FROM e q, e WHERE q.id % 20 = 0 AND e.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) k FROM s),
o AS (SELECT *, id % 10 <> 3 AND id % 4 < 3 AND ql = el ok, qid % 40 = 0 paginas, abs(id % 50 - qid % 50) <= 10 pag FROM r WHERE k <= 6), b AS (SELECT qid, any_value(ql) ql, bool_or(ok) hit, bool_or(ok AND pag) page, any_value(paginas) paginas FROM o GROUP BY 1)
SELECT ql label, count(*) n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) hit6, count(*) FILTER (paginas) con_pagina, count(*) FILTER (paginas AND page) pagina6 FROM b GROUP BY 1""")
def hit_at_k(spark, sf):
    """Share of questions of which one of the six best answers is of the expected manual and kind; of those that name pages, how many hit one. Generated answers don't count."""
    c = chunks(spark, sf)
    q = c.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("label").alias("ql"), F.col("vec").alias("qvec"))
    s = op.k_best(op.packed(q, "qid", "qvec", "ql"), op.packed(c, "id", "vec", "label"), 6, others=True).withColumnRenamed("qlabel", "ql")
    official, kind = F.col("id") % 10 != 3, F.col("id") % 4 < 3
    ok = official & kind & (F.col("ql") == F.col("label"))
    page = F.abs(F.col("id") % 50 - F.col("qid") % 50) <= 10
    b = s.groupBy("qid").agg(F.first("ql").alias("ql"), F.bool_or(ok).alias("hit"), F.bool_or(ok & page).alias("page"))
    paged = F.col("qid") % 40 == 0
    return b.groupBy(F.col("ql").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit6"), F.count_if(paged).alias("con_pagina"), F.count_if(paged & F.col("page")).alias("pagina6"))


REL = f"""s AS (SELECT q.id qid, e.id, e.label, {DOT.format("q.v", "e.v")} sim FROM e q, e WHERE q.id % 20 = 0 AND e.id <> q.id)"""


@query(f"""WITH {E}, {REL}, m AS (SELECT *, max(sim) OVER (PARTITION BY qid) b FROM s) SELECT qid, id, round(sim, 6) sim FROM m WHERE CASE WHEN label < 6 THEN sim >= 0.32 AND sim >= b - 0.12 ELSE sim >= 0.35 END""")
def relative_threshold(spark, sf):
    """Recordings count if they are like the question and nearly as like as the best answer of any kind; written manuals by an absolute bound alone."""
    c = chunks(spark, sf)
    q, v = asked(c, 20), op.packed(c.withColumn("written", F.when(F.col("label") < 6, 0).otherwise(1)), "id", "vec", "written")
    best = op.k_best(op.packed(q, "qid", "qvec"), v, 1, others=True).select("qid", F.greatest(F.lit(0.32), F.col("sim") - 0.12).alias("least"))
    # a floor for recordings and one for manuals
    q = q.join(best.hint("merge"), "qid").withColumn("floors", F.array("least", F.lit(0.35)))
    return op.at_least(op.packed(q, "qid", "qvec", floors="floors"), v).select("qid", "id", F.round("sim", 6).alias("sim"))


@query(f"""WITH {E}, {REL}, i AS (SELECT *, row_number() OVER (PARTITION BY qid, label = qid // 20 % 13 ORDER BY sim DESC, id) k, bool_or(label = qid // 20 % 13) OVER (PARTITION BY qid) dentro FROM s),
u AS (SELECT qid, id, sim, CASE WHEN label = qid // 20 % 13 THEN 0 ELSE 1 END o, k FROM i WHERE k <= CASE WHEN label = qid // 20 % 13 THEN 5 WHEN dentro THEN 3 ELSE 8 END), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY o, k) AS INTEGER) pos FROM u)
SELECT qid, id, pos FROM r WHERE pos <= 8""")
def soft_scope(spark, sf):
    """Five places for answers in scope and three for those out of it; all eight for the others where the scope is empty, as three of thirteen here are."""
    c = chunks(spark, sf)
    q = asked(c, 20).withColumn("scope", F.floor(F.col("qid") / 20) % 13)
    u = op.k_best(op.packed(q, "qid", "qvec", "scope"), op.packed(c, "id", "vec", "label"), 8, lambda q, v: q != v, 2, others=True).withColumnsRenamed({"part": "o", "rank": "k"})
    inside = F.min("o").over(Window.partitionBy("qid")) == 0
    u = u.withColumn("most", F.when(F.col("o") == 0, 5).when(inside, 3).otherwise(8)).filter("k <= most")
    return u.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("o", "k"))).filter("pos <= 8").select("qid", "id", "pos")


@query(f"""WITH {E}, {REL}, t AS (SELECT *, CASE WHEN label < 6 THEN 'pdf' WHEN label < 9 THEN 'video' ELSE 'generado' END tipo FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY qid, tipo ORDER BY sim DESC, id) k FROM t),
p AS (SELECT qid, id, label, CASE WHEN tipo = 'pdf' AND k <= 4 THEN 0 WHEN tipo = 'video' AND k <= 2 THEN 1 WHEN tipo = 'pdf' THEN 2 WHEN tipo = 'video' THEN 3 ELSE 4 END slot, k, id % 40 meta FROM k WHERE k <= 12),
d AS (SELECT *, row_number() OVER (PARTITION BY qid, meta ORDER BY slot, k) dd FROM p), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY slot, k) AS INTEGER) pos FROM d WHERE dd = 1) SELECT qid, id, pos FROM r WHERE pos <= 6""")
def priority_concat(spark, sf):
    """Slots by kind, the first of equal metadata, six in all."""
    c = chunks(spark, sf)
    pdf, video, made = 0, 1, 2
    kind = F.when(F.col("label") < 6, pdf).when(F.col("label") < 9, video).otherwise(made)
    s = op.k_best(op.packed(asked(c, 20), "qid", "qvec"), op.packed(c.withColumn("tipo", kind), "id", "vec", "tipo"), 12, lambda q, v: v, 3, others=True).withColumnsRenamed({"part": "tipo", "rank": "k"})
    slot = F.when((F.col("tipo") == pdf) & (F.col("k") <= 4), 0).when((F.col("tipo") == video) & (F.col("k") <= 2), 1).when(F.col("tipo") == pdf, 2).when(F.col("tipo") == video, 3).otherwise(4)
    s = s.withColumn("slot", slot)
    once = F.row_number().over(Window.partitionBy("qid", F.col("id") % 40).orderBy("slot", "k"))
    s = s.withColumn("d", once).filter("d = 1")
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("slot", "k"))).filter("pos <= 6").select("qid", "id", "pos")


@query(f"""WITH {E}, {CENT}, s AS (SELECT e.label, e.id, {DOT.format("c.cv", "e.v")} sim FROM e JOIN c ON e.label = c.label), f AS (SELECT *, id // 10 frag FROM s), r AS (SELECT *, count(*) OVER (PARTITION BY frag) n, row_number() OVER (PARTITION BY frag ORDER BY sim DESC, id) k FROM f)
SELECT frag, string_agg('s' || id, ' ' ORDER BY id) texto FROM r WHERE n <= 3 OR k <= 3 GROUP BY 1""")
def focus_compress(spark, sf):
    """Of a fragment with more than three sentences the three nearest to the topic, in their own order."""
    c = chunks(spark, sf)
    s = c.join(centroids(c), "label").select("id", F.floor(F.col("id") / 10).alias("frag"), dot("cv", "vec").alias("sim"))
    s = op.ranked(s, ["frag"], 3, "id")
    return s.groupBy("frag").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: F.concat(F.lit("s"), x)), " ").alias("texto"))


@query(f"""WITH {E}, x AS (SELECT id qid, v FROM e WHERE id % 10 = 0), s AS (SELECT y.id, max({DOT.format("x.v", "y.v")}) sim FROM e y, x WHERE y.id % 10 <> 0 GROUP BY 1), t AS (SELECT * FROM s WHERE sim < 0.75 ORDER BY sim, id LIMIT 12)
SELECT id, round(sim, 6) sim, CAST(row_number() OVER (ORDER BY id % 7, id) AS INTEGER) pos FROM t""")
def new_fragments(spark, sf):
    """The twelve fragments of a new version that are least like any old one, put back into the order of their pages (id modulo 7)."""
    c = chunks(spark, sf)
    best = op.max_similarity(c.filter("id % 10 <> 0").select("id", "vec"), asked(c, 10))
    return best.filter("sim < 0.75").orderBy("sim", "id").limit(12).select("id", F.round("sim", 6).alias("sim"), F.row_number().over(Window.orderBy(F.col("id") % 7, "id")).alias("pos"))  # twelve rows


@query(f"""WITH {E}, g AS (SELECT id % 40 voz, label, id, v FROM e), n AS (SELECT voz, count(*) n FROM g GROUP BY 1), t AS (SELECT g.* FROM g JOIN n ON g.voz = n.voz AND n <= 12), b AS (SELECT g.* FROM g JOIN n ON g.voz = n.voz AND n > 12),
s AS (SELECT t.voz, b.voz gran, max({DOT.format("t.v", "b.v")}) sim FROM t, b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY voz ORDER BY sim DESC, gran) k FROM s), w AS (SELECT voz, max(gran) FILTER (k = 1) gran, max(sim) FILTER (k = 1) s1, coalesce(max(sim) FILTER (k = 2), 0) s2 FROM r GROUP BY 1)
SELECT voz, CASE WHEN s1 >= 0.45 AND s1 - s2 >= 0.01 THEN gran ELSE voz END destino FROM w""")
def tiny_absorb(spark, sf):
    """A voice of few segments goes to the large voice it is like, if it is so by a margin."""
    c = chunks(spark, sf).withColumn("voz", F.col("id") % 40)
    n = c.groupBy("voz").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(n, "voz")
    two = op.best_two(c.filter("n <= 12").select(F.col("voz").alias("qid"), F.col("vec").alias("qvec")), c.filter("n > 12").select(F.col("voz").alias("persona"), F.col("vec").alias("evec")))
    ok = op.with_margin(two, 0.45, 0.01)
    return ok.select(F.col("qid").alias("voz"), F.coalesce("persona", "qid").alias("destino"))


def _index(spark, sf) -> str:
    path = scratch(spark, "index")
    index.build(chunks(spark, sf), path, by=("label",))
    return path


#: Share of the cells that a question asks.
PROBED = 0.75


@query(f"""WITH {E}, s AS (SELECT q.id qid, e.id, {DOT.format("q.v", "e.v")} sim FROM e q, e WHERE q.id % 20 = 0 AND e.label IN (2, 4)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS INTEGER) rank FROM s) SELECT qid, id, round(sim, 6) sim, rank FROM r WHERE rank <= 6""")
def index_exact(spark, sf):
    """The index asked in all its cells, of two labels alone: what every pair gives."""
    return index.search(spark, _index(spark, sf), asked(chunks(spark, sf), 20), 6, None, F.col("label").isin(2, 4)).select("qid", "id", F.round("sim", 6).alias("sim"), "rank")


@query("SELECT count(*) FILTER (vec_id % 20 = 0) consultas, true suficiente FROM embeddings")
def index_recall(spark, sf):
    """Whether the index finds nine tenths of the ten best, asked in PROBED of its cells, against the exact search of all rows."""
    c, path = chunks(spark, sf), scratch(spark, "index")
    cells = index.build(c, path)
    found = index.search(spark, path, asked(c, 20), 10, max(1, round(PROBED * cells)))
    r = index.recall(found, op.knn(asked(c, 20), c, 10))
    return r.select(F.col("queries").alias("consultas"), (F.col("recall") >= 0.9).alias("suficiente"))


@query(f"""WITH {E}, n AS (SELECT label, count(*) n FROM e GROUP BY 1) SELECT label, true muestra, true cerca FROM n WHERE n > 1""")
def random_mean(spark, sf):
    """Whether the mean of two hundred random pairs of each topic lies within five standard errors of the mean of all its pairs, which comes from the sum of its vectors."""
    c = chunks(spark, sf)
    drawn = op.random_pairs(c, 200, seed=7, by="label")
    n = F.count(F.lit(1))
    size = c.groupBy("label").agg(n.alias("n"), F.sum(dot("vec", "vec")).alias("own"))
    total = mean_vector(c, ["label"], "vec").join(size, "label").filter("n > 1")
    # all ordered pairs of different rows: the square of the sum without the rows' own
    every = total.select("label", "n", ((dot("centroid", "centroid") * F.col("n") * F.col("n") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("todas"))
    j = every.join(drawn, "label")
    return j.select("label", (F.col("pares") >= F.least(F.lit(200), F.col("n")) - 20).alias("muestra"), (F.abs(F.col("media") - F.col("todas")) <= 5 * F.col("error") + 1e-9).alias("cerca"))
