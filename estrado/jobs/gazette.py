"""Gazettes written out of the given tables and read back; the SQL knows what they were written from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import gazette as gz
from ..functions import text as tx
from ..operators import parties
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query(r"""WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'PÉREZ NÚÑEZ' WHEN 'assistant' THEN 'GIL-ROBLES' ELSE 'PRESIDENTA' END speaker, CASE WHEN turn % 2 = 0 THEN 'Grupo Mixto' ELSE '' END party, regexp_replace(text, '^\s+|\s+$', '', 'g') text FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) idx, speaker, party, text FROM c WHERE text <> ''""")
def gazette_speeches(spark, sf):
    name = F.when(F.col("role") == "user", "El señor PÉREZ NÚÑEZ").when(F.col("role") == "assistant", "La señora GIL-ROBLES").otherwise("La señora PRESIDENTA")
    line = F.concat(name, F.when(F.col("turn") % 2 == 0, " (Grupo Mixto)").otherwise(""), F.lit(": "), "text", F.lit("\n"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", line.alias("l"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "l"))).alias("l"))
    text = F.concat(F.lit("DIARIO DE SESIONES DEL CONGRESO\nPág. 3\nSumario\n"), F.array_join(F.transform("l", lambda x: x["l"]), ""))
    return g.select("conv_id", F.posexplode(gz.speeches(F.regexp_replace(text, gz.PAGE_HEADER, " "))).alias("idx", "s")).select("conv_id", "idx", "s.*")


@query(r"""WITH c AS (SELECT conv_id, turn, role = 'user' mesa, regexp_replace(ltrim(text, ' .—-'), '\s+', ' ', 'g') || ' ' t FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) idx, CASE WHEN mesa THEN 'El presidente' ELSE 'Íñiga Ruiz-López' END speaker, CASE WHEN mesa THEN '' ELSE 'Más Madrid' END party, CASE WHEN mesa THEN 'presidencia' ELSE 'concejal' END AS role, t AS text FROM c WHERE length(t) > 15""".replace("\\\\", "\\"))
def gazette_council(spark, sf):
    """Speeches out of a city council's gazette, whose page headers stand within marks and whose summary comes before the session."""
    mark = F.when(F.col("role") == "user", "El presidente: ").otherwise("La portavoz del Grupo Municipal Más Madrid, doña Íñiga\tDiario de Sesiones del Pleno del Ayuntamiento de Madrid\n3 de marzo   Núm. 1.234 Ruiz-López: ")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(mark, "text", F.lit("\n")).alias("l"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "l"))).alias("l"))
    text = F.concat(F.lit("SUMARIO\nEl presidente: esto es el sumario y no cuenta\nSe abre la sesión a las diez\n"), F.array_join(F.transform("l", lambda x: x["l"]), ""))
    return g.select("conv_id", F.posexplode(gz.council_speeches(text)).alias("idx", "s")).select("conv_id", "idx", "s.*")


@query(r"""WITH s AS (SELECT s_suppkey % 4 leg, upper(translate(n_name, '_#0123456789', '  ABCDEFGHIJ')) AS n, CASE s_suppkey % 4 WHEN 0 THEN 'PSOE' WHEN 1 THEN 'PP' WHEN 2 THEN 'Mixto' END g FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT leg, array_to_string(list_filter(string_split(trim(regexp_replace(n, '\s+', ' ', 'g')), ' '), lambda t: t <> 'I'), ' ') orador, g, count(*) n FROM s WHERE g IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY leg, orador ORDER BY n DESC, g) k FROM c) SELECT leg, orador, g partido, n FROM r WHERE k = 1""")
def party_map(spark, sf):
    """Each speaker's group by term, as most of the mentions in summaries have it; groups that are not known don't count."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    m = F.col("s_suppkey") % 4
    group = F.when(m == 0, "Socialista").when(m == 1, "Popular en el Congreso").when(m == 2, "Mixto").otherwise("de la Concordia")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 nations
    name = F.concat(F.upper(F.left("n_name", F.lit(1))), F.lower(F.translate(F.substr("n_name", F.lit(2), F.lit(100)), "_#0123456789", "  ABCDEFGHIJ")))
    first = F.concat(F.lit("del señor "), name, F.lit(", del Grupo Parlamentario "), group, F.lit("."))
    second = F.concat(F.lit("del Grupo Parlamentario "), group, F.lit(" (señora "), name, F.lit(")."))
    t = j.select((F.col("s_suppkey") % 4).alias("leg"), F.when(F.floor(F.col("s_suppkey") / 4) % 2 == 0, first).otherwise(second).alias("text"))
    return parties.party_map(t).select("leg", F.col("name").alias("orador"), F.col("sigla").alias("partido"), "n")


@query("""WITH p AS (SELECT p_size k, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) i, 'Aprobación de ' || p_name t FROM part) SELECT k, CAST(i - 1 AS INTEGER) punto, t titulo FROM p WHERE i <= 40""")
def agenda_points(spark, sf):
    """Points read from a summons with a footer and a signature: the first forty, which is what the reader takes."""
    p = table(spark, sf, "part")
    i = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    p = p.withColumn("i", i).select("p_size", "i", F.concat("i", F.lit(".- Aprobación de   "), "p_name", F.lit("\n")).alias("l"))
    g = p.groupBy(F.col("p_size").alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]), "").alias("l"))
    t = F.concat(F.lit("CONVOCATORIA\nOrden del día\n"), "l", F.lit("Documento firmado electrónicamente CSV: x\nFdo.: la secretaria\n9. no es un punto"))
    return g.select("k", F.posexplode(gz.agenda(t)).alias("punto", "titulo"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Asuntos de ' || o_orderpriority || ' y ' || o_custkey WHEN 1 THEN '1.- Lectura del acta de ' || o_custkey ELSE 'Lectura del acta' || chr(10) || 'Mociones de ' || o_custkey END orden FROM orders""")
def agenda_block(spark, sf):
    """The agenda out of a summons as text: a point a line, or the whole block where there are fewer than two points."""
    o, m = table(spark, sf, "orders"), F.col("o_orderkey") % 3
    who = F.col("o_custkey").cast("string")
    none = F.concat(F.lit("Asuntos  de "), "o_orderpriority", F.lit("\n y "), who)
    one, two = F.concat(F.lit("1.- Lectura del acta de "), who), F.concat(F.lit("1. Lectura del acta\n2º- Mociones de "), who)
    t = F.concat(F.lit("Convocatoria\nORDEN DEL DÍA\n"), F.when(m == 0, none).when(m == 1, one).otherwise(two), F.lit("\nfirmado: el alcalde"))
    return o.select("o_orderkey", gz.agenda_text(t).alias("orden"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') fecha FROM orders""")
def session_dates(spark, sf):
    """The date in a gazette's head."""
    long = tx.long_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    head = F.concat(F.lit("Sesión plenaria núm. 2\ncelebrada el martes "), long, F.lit(", en el salón"))
    return table(spark, sf, "orders").select("o_orderkey", tx.iso_date(gz.held_on(head)).alias("fecha"))


@query("""SELECT o_orderkey, 'Debate de ' || o_orderpriority || ' y de cliente ' || o_custkey tema FROM orders""")
def session_topics(spark, sf):
    """The agenda's block in a gazette's head, without dotted leaders and what follows it."""
    head = F.concat(F.lit("ORDEN DEL DÍA:\n  Debate de "), "o_orderpriority", F.lit(" ......... 12 y de\ncliente "), F.col("o_custkey").cast("string"), F.lit(" ..... 7\nSUMARIO\nSe abre la sesión"))
    return table(spark, sf, "orders").select("o_orderkey", gz.session_topic(head).alias("tema"))
