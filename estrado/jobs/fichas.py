"""Fichas over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fichas as op
from ..sources.tables import IV, interventions, speeches, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


NO_CHAIR = "lower(role) <> 'presidencia' AND party <> 'Presidencia'"


@query(f"WITH {IV} SELECT speaker, count(*) n, count(DISTINCT pleno_id) n_plenos, min(fecha_iso) desde, max(fecha_iso) hasta, CAST(coalesce(sum(n_words), 0) AS BIGINT) palabras FROM iv GROUP BY 1")
def ficha_speaker_head(spark, sf):
    return op.head(interventions(spark, sf), "speaker")


@query(f"""WITH {IV}, c AS (SELECT speaker, topic, count(*) n FROM iv WHERE coalesce(topic, '') <> '' GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY speaker ORDER BY n DESC, topic) AS INTEGER) rank FROM c) SELECT speaker, topic, n, rank FROM r WHERE rank <= 8""")
def ficha_facets_topk(spark, sf):
    return op.top_facets(interventions(spark, sf), "speaker", "topic", 8)


@query(f"""WITH {IV}, d AS (SELECT DISTINCT speaker, pleno_id, fecha_iso FROM iv),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY speaker ORDER BY fecha_iso DESC, pleno_id DESC) AS INTEGER) rank FROM d) SELECT * FROM r WHERE rank <= 8""")
def ficha_recent_sessions(spark, sf):
    return op.recent_sessions(interventions(spark, sf), "speaker")


@query(f"""WITH {IV}, f AS (SELECT con_mesa, iv.* FROM iv, (SELECT unnest([false, true]) con_mesa) WHERE con_mesa OR {NO_CHAIR}),
s AS (SELECT con_mesa, party, string_agg(speaker, '|' ORDER BY k) oradores_top FROM (SELECT con_mesa, party, speaker, row_number() OVER (PARTITION BY con_mesa, party ORDER BY count(*) DESC, speaker) k FROM f GROUP BY 1, 2, 3) WHERE k <= 10 GROUP BY 1, 2),
t AS (SELECT con_mesa, party, string_agg(topic, '|' ORDER BY k) temas FROM (SELECT con_mesa, party, topic, row_number() OVER (PARTITION BY con_mesa, party ORDER BY count(*) DESC, topic) k FROM f WHERE coalesce(topic, '') <> '' GROUP BY 1, 2, 3) WHERE k <= 10 GROUP BY 1, 2)
SELECT f.con_mesa, f.party, count(*) n, count(DISTINCT pleno_id) n_plenos, count(DISTINCT speaker) oradores, min(fecha_iso) desde, max(fecha_iso) hasta, CAST(coalesce(sum(n_words), 0) AS BIGINT) palabras, any_value(oradores_top) oradores_top, any_value(temas) temas
FROM f LEFT JOIN s ON s.con_mesa = f.con_mesa AND s.party = f.party LEFT JOIN t ON t.con_mesa = f.con_mesa AND t.party = f.party GROUP BY 1, 2""")
def ficha_party(spark, sf):
    """Parties with and without the chair: counts, dates, words, ten speakers and ten topics."""
    return op.party(interventions(spark, sf))


@query(f"""WITH {IV}, w AS (SELECT pleno_id, speaker, sum(n_words) w, count(*) n FROM iv WHERE {NO_CHAIR} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pleno_id ORDER BY w DESC, speaker) k FROM w), t AS (SELECT pleno_id, string_agg(speaker || ':' || n || ':' || CAST(w AS BIGINT), '|' ORDER BY k) oradores FROM r WHERE k <= 10 GROUP BY 1),
p AS (SELECT pleno_id, string_agg(party || ':' || n, '|' ORDER BY n DESC, party) reparto FROM (SELECT pleno_id, party, count(*) n FROM iv WHERE party <> '' GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT pleno_id, string_agg(DISTINCT topic, '|' ORDER BY topic) temas FROM iv WHERE topic <> '' GROUP BY 1), h AS (SELECT o_orderkey pleno_id, strftime(o_orderdate, '%Y-%m-%d') fecha, CAST(year(o_orderdate) AS INTEGER) legislatura, o_orderpriority tema_sesion, o_orderkey % 3 v FROM orders)
SELECT h.pleno_id, fecha, legislatura, tema_sesion, (SELECT count(*) FROM iv WHERE iv.pleno_id = h.pleno_id) intervenciones, reparto, oradores, temas, CASE WHEN v = 0 THEN 0 ELSE v END n_votaciones, CASE v WHEN 0 THEN '' WHEN 1 THEN '1-2-0' ELSE '1-2-0|3-4-1' END votaciones
FROM h LEFT JOIN t USING (pleno_id) LEFT JOIN p USING (pleno_id) LEFT JOIN d USING (pleno_id)""")
def ficha_session(spark, sf):
    """Sessions: header, interventions, split by party, ten speakers by words, topics and the counted votes. A vote's counts come from the header's JSON."""
    votes = F.when(F.col("o_orderkey") % 3 == 0, "[]").when(F.col("o_orderkey") % 3 == 1, '[{"a_favor":1,"en_contra":2,"abstenciones":0}]').otherwise('[{"a_favor":1,"en_contra":2,"abstenciones":0},{"a_favor":3,"en_contra":4,"abstenciones":1}]')
    o = table(spark, sf, "orders")
    head = o.select(F.col("o_orderkey").alias("pleno_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"), F.year("o_orderdate").alias("legislatura"), F.col("o_orderpriority").alias("tema_sesion"), votes.alias("votaciones_json"))
    return op.session(head, speeches(spark, sf))


@query(f"""WITH {IV}, c AS (SELECT legislatura, topic, count(*) n FROM iv WHERE coalesce(topic, '') <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY legislatura ORDER BY n DESC, topic) rank FROM c),
t AS (SELECT legislatura, string_agg(topic, '|' ORDER BY rank) temas FROM r WHERE rank <= 3 GROUP BY 1)
SELECT iv.legislatura, count(*) n, count(DISTINCT pleno_id) n_plenos, min(fecha_iso) desde, max(fecha_iso) hasta, any_value(temas) temas FROM iv LEFT JOIN t ON iv.legislatura = t.legislatura GROUP BY 1""")
def evolution_top3(spark, sf):
    o = table(spark, sf, "orders")
    heads = o.select(F.col("o_orderkey").alias("pleno_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha_iso"), F.year("o_orderdate").alias("legislatura"), F.col("o_orderpriority").alias("topic"))
    return op.evolution_by_head(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pleno_id")), heads)


@query(f"WITH {IV} SELECT party, count(*) n FROM iv WHERE {NO_CHAIR} AND party <> '' GROUP BY 1")
def party_list(spark, sf):
    return interventions(spark, sf).filter(op.substantive() & (F.col("party") != "")).groupBy("party").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {IV}, t AS (SELECT unnest([0, 10, 15, 20, 30, 50]) umbral)
SELECT CAST(umbral AS INTEGER) umbral, count(*) FILTER (NOT ({NO_CHAIR}) OR n_words < umbral) quitadas, CAST(coalesce(sum(n_words) FILTER (NOT ({NO_CHAIR}) OR n_words < umbral), 0) AS BIGINT) palabras,
count(*) total, round(100.0 * count(*) FILTER (NOT ({NO_CHAIR}) OR n_words < umbral) / count(*), 2) pct FROM iv, t GROUP BY umbral""")
def prune_stats(spark, sf):
    return op.prune_stats(interventions(spark, sf), [0, 10, 15, 20, 30, 50])


@query(f"WITH {IV} SELECT speaker, min(party) clave, count(*) n FROM iv GROUP BY 1")
def speaker_first_count(spark, sf):
    return interventions(spark, sf).groupBy("speaker").agg(F.min("party").alias("clave"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {IV} SELECT CASE WHEN coalesce(trim(party), '') = '' THEN '—' ELSE party END party, count(*) n FROM iv GROUP BY 1")
def party_histogram(spark, sf):
    shown = F.coalesce(F.nullif(F.trim("party"), F.lit("")), F.lit("—")).alias("party")
    return interventions(spark, sf).groupBy(shown).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {IV}, m AS (SELECT legislatura, speaker, count(DISTINCT party) p FROM iv WHERE party <> '' AND role = 'diputado' GROUP BY 1, 2), v AS (SELECT CAST(year(o_orderdate) AS INTEGER) legislatura, round(100.0 * count(*) FILTER (o_orderkey % 3 > 0) / count(*), 2) pct_con_votos FROM orders GROUP BY 1)
SELECT iv.legislatura, count(*) n, count(*) FILTER (role = 'presidencia') presidencia, count(*) FILTER (role = 'diputado') diputados, round(100.0 * count(*) FILTER (party = '' AND role = 'diputado') / greatest(count(*) FILTER (role = 'diputado'), 1), 2) pct_sin_partido,
round(100.0 * count(*) FILTER (coalesce(topic, '') <> '') / count(*), 2) pct_con_tema, any_value(x.varios) varios, any_value(pct_con_votos) pct_con_votos FROM iv LEFT JOIN (SELECT legislatura, count(*) FILTER (p > 1) varios FROM m GROUP BY 1) x ON iv.legislatura = x.legislatura LEFT JOIN v ON iv.legislatura = v.legislatura GROUP BY 1""")
def corpus_quality(spark, sf):
    """By term: roles, deputies' rows without a party, rows with a topic, deputies with several parties, and the share of sessions with votes."""
    voted = table(spark, sf, "orders").select(F.year("o_orderdate").alias("legislatura"), (F.col("o_orderkey") % 3 > 0).alias("voted"))
    return op.quality(interventions(spark, sf), voted)


@query(f"""WITH {IV}, c AS (SELECT legislatura, speaker, party, count(*) n FROM iv WHERE role = 'diputado' GROUP BY 1, 2, 3), s AS (SELECT legislatura, speaker, CAST(sum(n) AS BIGINT) n, coalesce(nullif(string_agg(party, '/' ORDER BY party) FILTER (party <> ''), ''), '—') partidos FROM c GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY legislatura ORDER BY n DESC, speaker) AS INTEGER) rank FROM s) SELECT legislatura, rank, speaker, n, partidos FROM r WHERE rank <= 10""")
def corpus_top(spark, sf):
    """The ten deputies of each term who speak most, with all their parties."""
    iv = interventions(spark, sf).filter("role = 'diputado'")
    s = iv.groupBy("legislatura", "speaker").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set(F.nullif("party", F.lit("")))), "/").alias("partidos"))
    rank = F.row_number().over(Window.partitionBy("legislatura").orderBy(F.desc("n"), "speaker"))
    s = s.withColumn("rank", rank).filter("rank <= 10")
    return s.select("legislatura", "rank", "speaker", "n", F.when(F.col("partidos") == "", "—").otherwise(F.col("partidos")).alias("partidos"))


@query(f"""WITH {IV} SELECT legislatura, max(struct_pack(fecha_iso := fecha_iso, pleno_id := pleno_id)).pleno_id ultimo, min(struct_pack(fecha_iso := fecha_iso, pleno_id := pleno_id)).pleno_id primero
FROM iv WHERE fecha_iso IS NOT NULL AND fecha_iso <> '' GROUP BY 1""")
def latest_earliest(spark, sf):
    iv = interventions(spark, sf)
    last, first = (op.edge_session(iv, x, "legislatura").select("legislatura", F.col("pleno_id").alias(n)) for x, n in ((True, "ultimo"), (False, "primero")))
    return last.join(first, "legislatura")


@query("""WITH p AS (SELECT o_orderkey, year(o_orderdate) leg, 'DSCD-' || CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END || '-PL-' || (o_orderkey % 900) pleno, CAST(o_orderkey % 900 AS VARCHAR) num FROM orders), q AS (SELECT DISTINCT leg, num FROM p UNION SELECT 1900, '7' UNION SELECT leg, '899' FROM p)
SELECT q.leg, q.num, coalesce(min(p.pleno) FILTER (p.pleno = 'DSCD-' || q.leg || '-PL-' || q.num), min(p2.pleno)) pleno FROM q LEFT JOIN (SELECT DISTINCT pleno FROM p) p ON p.pleno = 'DSCD-' || q.leg || '-PL-' || q.num LEFT JOIN (SELECT leg, num, min(pleno) pleno FROM p GROUP BY 1, 2) p2 ON p2.leg = q.leg AND p2.num = q.num GROUP BY 1, 2""")
def pleno_by_legislature(spark, sf):
    """A session by its term and number: the one whose id says so, else one of that term with that number."""
    o, year = table(spark, sf, "orders"), F.year("o_orderdate")
    said = F.when(F.col("o_orderkey") % 3 == 0, year - 1).otherwise(year)
    p = o.select(year.alias("legislatura"), F.concat(F.lit("DSCD-"), said, F.lit("-PL-"), F.col("o_orderkey") % 900).alias("pleno_id"))
    asked = p.select(F.col("legislatura").alias("leg"), F.regexp_extract("pleno_id", r"(\d+)$", 1).alias("num"))
    asked = asked.union(asked.select("leg", F.lit("899"))).union(spark.createDataFrame([(1900, "7")], "leg int, num string")).distinct()
    return op.by_number(asked, p).select("leg", "num", F.col("pleno_id").alias("pleno"))


@query("""WITH p AS (SELECT o_orderkey, 'DS-' || year(o_orderdate) || '-PL-' || (o_orderkey % 400) pleno FROM orders), n AS (SELECT CAST(unnest(range(0, 400)) AS BIGINT) num)
SELECT num, count(o_orderkey) candidatos, CASE WHEN count(o_orderkey) = 1 THEN min(pleno) END pleno FROM n LEFT JOIN p ON suffix(pleno, '-PL-' || num) GROUP BY 1""")
def pleno_by_number(spark, sf):
    """A session by its number alone, where exactly one has it: the number is cut out of the id, so the join is on equality."""
    o = table(spark, sf, "orders")
    p = o.select(F.concat(F.lit("DS-"), F.year("o_orderdate"), F.lit("-PL-"), F.col("o_orderkey") % 400).alias("pleno"))
    p = p.withColumn("num", F.regexp_extract("pleno", r"-PL-(\d+)$", 1).cast("long"))
    g = p.groupBy("num").agg(F.count(F.lit(1)).alias("candidatos"), F.min("pleno").alias("pleno"))
    n = spark.range(400).withColumnRenamed("id", "num")
    return n.join(g, "num", "left").select("num", F.coalesce("candidatos", F.lit(0)).alias("candidatos"), F.when(F.col("candidatos") == 1, F.col("pleno")).alias("pleno"))


@query("""SELECT o_orderkey pleno_id, strftime(o_orderdate, '%Y-%m-%d') fecha_iso, c_name entidad, n_name slug FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS NOT NULL""")
def sessions_by_entity(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")  # nation: 25 rows in any size
    return j.filter("n_name is not null").select(F.col("o_orderkey").alias("pleno_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha_iso"), F.col("c_name").alias("entidad"), F.col("n_name").alias("slug"))


@query(f"WITH {IV} SELECT pleno_id, idx, speaker FROM iv WHERE party = 'R' AND speaker IN ('sp1', 'sp2', 'sp3')")
def metadata_filter(spark, sf):
    return interventions(spark, sf).filter(op.where(**{op.ENTITY_COLUMN["partido"]: "R", "topic": None, "speaker": ["sp1", "sp2", "sp3"]})).select("pleno_id", "idx", "speaker")


@query(f"WITH {IV} SELECT pleno_id, idx, n_words FROM iv WHERE has_text AND lower(role) <> 'presidencia' AND party <> 'Presidencia' AND n_words >= 45")
def substantive_only(spark, sf):
    return interventions(spark, sf).filter(op.substantive() & F.col("has_text") & (F.col("n_words") >= 45)).select("pleno_id", "idx", "n_words")


@query(f"WITH {IV}, c AS (SELECT speaker, count(*) hits, sum(n_words) n FROM iv WHERE party = 'A' GROUP BY 1) SELECT speaker, hits, CAST(n AS BIGINT) n FROM c ORDER BY hits DESC, n DESC, speaker LIMIT 25")
def speakers_ranked(spark, sf):
    c = interventions(spark, sf).filter("party = 'A'").groupBy("speaker").agg(F.count(F.lit(1)).alias("hits"), F.sum("n_words").alias("n"))
    return c.orderBy(F.desc("hits"), F.desc("n"), "speaker").limit(25)


@query(f"""WITH {IV}, b AS (SELECT topic, party, pleno_id, idx, count(*) OVER (PARTITION BY topic, party) n FROM iv WHERE party <> ''),
g AS (SELECT *, dense_rank() OVER (PARTITION BY topic ORDER BY n DESC, party) g, row_number() OVER (PARTITION BY topic, party ORDER BY pleno_id, idx) k FROM b)
SELECT topic, party, pleno_id, idx, n FROM g WHERE g <= 6 AND k <= 3""")
def topic_overview(spark, sf):
    """The largest parties of each topic with three fragments each."""
    iv = interventions(spark, sf).filter("party <> ''")
    n = iv.groupBy("topic", "party").agg(F.count(F.lit(1)).alias("n"))
    big = n.withColumn("g", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "party"))).filter("g <= 6").drop("g")
    k = F.row_number().over(Window.partitionBy("topic", "party").orderBy("pleno_id", "idx"))
    return iv.select("topic", "party", "pleno_id", "idx", k.alias("k")).filter("k <= 3").drop("k").join(big, ["topic", "party"])
