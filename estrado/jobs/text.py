"""Text rules over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import record as rec
from ..functions import text as tx
from ..operators import sections
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


KEY = r"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^0-9a-z\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def _case(key: str, rules, otherwise: str, test="contains({0}, '{1}')") -> str:
    return "CASE " + " ".join(f"WHEN {test.format(key, a)} THEN '{b}'" for a, b in rules) + f" ELSE {otherwise} END"


@query(f"SELECT doc_id, {KEY.format('text')} clave FROM documents")
def norm_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.norm_key(F.col("text")).alias("clave"))


#: Labels of groups, cut out of given rows: the name of a part or a source and the words around it.
LABEL = "CASE p_partkey % 6 WHEN 0 THEN 'Grupo Parlamentario ' || p_name WHEN 1 THEN p_brand || ' Popular en el Congreso' WHEN 2 THEN 'Esquerra ' || p_name WHEN 3 THEN 'Coalición CANARIA' WHEN 4 THEN 'el pp y ' || p_name ELSE '' END"


def _labels(spark, sf):
    p = table(spark, sf, "part")
    m = F.col("p_partkey") % 6
    label = F.when(m == 0, F.concat(F.lit("Grupo Parlamentario "), "p_name")).when(m == 1, F.concat("p_brand", F.lit(" Popular en el Congreso"))).when(m == 2, F.concat(F.lit("Esquerra "), "p_name"))
    label = label.when(m == 3, "Coalición CANARIA").when(m == 4, F.concat(F.lit("el pp y "), "p_name")).otherwise("")
    return p.select("p_partkey", label.alias("label"))


@query(f"""WITH l AS (SELECT p_partkey, {LABEL} label FROM part), k AS (SELECT *, {KEY.format('label')} k FROM l)
SELECT p_partkey, CASE WHEN k = '' THEN '' ELSE {_case('k', tx.PARTY_RULES, "regexp_replace(label, '^grupo parlamentario\\s+', '', 'i')")} END partido FROM k""")
def canonical_party(spark, sf):
    return _labels(spark, sf).select("p_partkey", tx.canonical_party(F.col("label")).alias("partido"))


@query(f"""WITH l AS (SELECT p_partkey, {LABEL} label FROM part), k AS (SELECT *, {KEY.format('label')} k FROM l)
SELECT p_partkey, {_case('k', tx.PARTY_RULES, _case("string_split(k, ' ')", tx.PARTY_WORDS, 'NULL', "list_contains({0}, '{1}')"))} partido FROM k""")
def detect_party(spark, sf):
    return _labels(spark, sf).select("p_partkey", tx.detect_party(F.col("label")).alias("partido"))


@query(r"""WITH w AS (SELECT doc_id, lower(text[1:4000]) t FROM documents), s AS (SELECT doc_id, replace(replace(replace(strip_accents(t), 'll', 'y'), 'qu', 'k'), 'gu', 'g') s FROM w),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, 'c([ei])', 's\1', 'g'), 'g([ei])', 'j\1', 'g'), 'c$', 's'), 'g$', 'j'), '[^\p{L}]|h', '', 'g') s FROM s)
SELECT doc_id, list_reduce(list_transform(string_split(translate(s, 'vzcy', 'bski'), ''), lambda c: c), lambda x, y: CASE WHEN right(x, 1) = y THEN x ELSE x || y END, '') fon FROM a""".replace("text[1:4000]", "text"))
def phonetic_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.phonetic_key(F.col("text")).alias("fon"))


@query(r"""SELECT c_custkey, CASE WHEN s = '' THEN 'entidad' ELSE s END slug FROM (SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(n)), '[^\x00-\x7f]', '', 'g'), '^\s*(ayuntamiento|ajuntament|concello|udala?)\s+(de\s+la\s+|de\s+|del\s+|d'')?', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') s
FROM (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Ayuntamiento de ' || c_name WHEN 1 THEN 'Diputación de ' || c_name WHEN 3 THEN 'Ajuntament d''' || c_name WHEN 4 THEN '  Concello de la ' || c_name WHEN 5 THEN 'Udala ' || c_name WHEN 2 THEN c_mktsegment || ' Ñandú!' ELSE '¿?' END n FROM customer))""")
def slugs(spark, sf):
    m = F.col("c_custkey") % 8
    before = {0: "Ayuntamiento de ", 1: "Diputación de ", 3: "Ajuntament d'", 4: "  Concello de la ", 5: "Udala "}
    n = F.when(m == 2, F.concat("c_mktsegment", F.lit(" Ñandú!")))
    for k, words in before.items():
        n = n.when(m == k, F.concat(F.lit(words), "c_name"))
    n = n.otherwise("¿?")
    return table(spark, sf, "customer").select("c_custkey", tx.slug(n).alias("slug"))


MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in tx.MONTHS) + "]"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE day(o_orderdate) || ' de ' || {MONTH_LIST}[month(o_orderdate)] || ' de ' || year(o_orderdate) END larga,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END iso FROM orders""")
def dates_both_ways(spark, sf):
    """ISO to long and back: every fifth is no date and stays, or becomes null."""
    o = table(spark, sf, "orders")
    given = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    o = o.select("o_orderkey", tx.long_date(given).alias("larga"))
    return o.select("o_orderkey", "larga", tx.iso_date(F.col("larga")).alias("iso"))


@query("""WITH s AS (SELECT event_id, CAST(floor(value * 60) AS BIGINT) s FROM events) SELECT event_id, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) reloj, printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) acta, printf('%d:%02d', s // 60, s % 60) minuto FROM s""")
def clocks(spark, sf):
    s = F.floor(F.col("value") * 60)
    return table(spark, sf, "events").select("event_id", tx.clock(s).alias("reloj"), tx.clock(s, pad=False).alias("acta"), tx.minutes(s).alias("minuto"))


@query("""WITH s AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n, round(value * 60, 3) a, round(value * 60, 3) + 2.5 b, event_type FROM events), t AS (SELECT *, printf('%02d:%02d:%02d,%03d', CAST(floor(a) AS BIGINT) // 3600, (CAST(floor(a) AS BIGINT) % 3600) // 60, CAST(floor(a) AS BIGINT) % 60, CAST(round((a - floor(a)) * 1000) AS INTEGER)) x,
printf('%02d:%02d:%02d,%03d', CAST(floor(b) AS BIGINT) // 3600, (CAST(floor(b) AS BIGINT) % 3600) // 60, CAST(floor(b) AS BIGINT) % 60, CAST(round((b - floor(b)) * 1000) AS INTEGER)) y FROM s)
SELECT event_id, n || chr(10) || x || ' --> ' || y || chr(10) || event_type || chr(10) linea FROM t""")
def srt_lines(spark, sf):
    """Captions of a session: number, from --> to, text, an empty line."""
    from pyspark.sql import Window

    start = F.round(F.col("value") * 60, 3)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_id", rec.caption(n, start, start + 2.5, F.col("event_type")).alias("linea"))


VOTE_TEXT = """CASE l_linenumber % 3 WHEN 0 THEN 'Votos emitidos, ' || 3 * q || '; a favor, ' || q || '; en contra, ' || 2 * q || '; abstenciones, 0. Fin'
WHEN 1 THEN q || ' votos a favor más 2 votos telemáticos, ' || q + 2 || '; ' || q + 7 || ' en contra y 15 abstenciones' ELSE 'nada que votar' END"""


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) q FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 3 * q END emitidos,
CASE WHEN l_linenumber % 3 = 0 THEN q ELSE q + 2 END a_favor, CASE WHEN l_linenumber % 3 = 0 THEN 2 * q ELSE q + 7 END en_contra, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 15 END abstenciones FROM v WHERE l_linenumber % 3 < 2""")
def votes_extract(spark, sf):
    """Results read back out of sentences in both formats; the SQL knows what the sentences were made of."""
    q = F.col("l_quantity").cast("int")
    m = F.col("l_linenumber") % 3
    said = F.when(m == 0, F.format_string("Votos emitidos, %d; a favor, %d; en contra, %d; abstenciones, 0. Fin", 3 * q, q, 2 * q))
    said = said.when(m == 1, F.format_string("%d votos a favor más 2 votos telemáticos, %d; %d en contra y 15 abstenciones", q, q + 2, q + 7)).otherwise("nada que votar")
    v = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", said.alias("t")).select("l_orderkey", "l_linenumber", F.explode(tx.votes(F.col("t"))).alias("v"))
    return v.select("l_orderkey", "l_linenumber", "v.emitidos", "v.a_favor", "v.en_contra", "v.abstenciones")


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) s FROM documents), m AS (SELECT doc_id, s, regexp_replace(s, '([.!?])\s+([A-ZÁÉÍÓÚÑ¿¡(])', '\1' || chr(1) || '\2', 'g') t FROM s)
SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(string_split(t, chr(1))) END n, CASE WHEN s <> '' THEN string_split(t, chr(1))[1] END primera, CASE WHEN s <> '' THEN string_split(t, chr(1))[-1] END ultima FROM m""")
def sentence_split(spark, sf):
    """Sentences of a text whose white space is squeezed first."""
    d = table(spark, sf, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.try_element_at("s", F.lit(1)).alias("primera"), F.try_element_at("s", F.lit(-1)).alias("ultima"))


@query(r"""WITH d AS (SELECT doc_id, text t FROM documents), s AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 25) a FROM d)
SELECT doc_id, len(a) frases, a[-1] ultima, len(string_split(regexp_replace(t, '([.:;!?])\s+', '\1' || chr(1), 'g'), chr(1))) clausulas FROM s""")
def sentence_kinds(spark, sf):
    """The two other ways to cut a text: statements of 25 characters or more, also at line ends, as summaries are checked by; and clauses, as pages are packed by."""
    d = table(spark, sf, "documents").select("doc_id", tx.statements(F.col("text")).alias("s"), tx.clauses(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("s").cast("long").alias("frases"), F.try_element_at("s", F.lit(-1)).alias("ultima"), F.size("c").cast("long").alias("clausulas"))


@query(r"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END palabras, length(text) n_chars, left(text, 320) preview FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) t FROM documents)""")
def word_stats(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.word_count(F.col("text")).cast("long").alias("palabras"), F.length("text").cast("long").alias("n_chars"), F.left("text", F.lit(320)).alias("preview"))


#: Questions put to the record: a template by the turn's number around words of the turn itself.
QUESTION = r"""CASE turn % 7 WHEN 0 THEN '¿Qué partido es el más honrado? ' || w WHEN 1 THEN 'Último pleno de la legislatura 14 sobre ' || w WHEN 2 THEN 'Pleno 107, legislatura 14: ' || w WHEN 3 THEN 'Vox y la vivienda: ' || w WHEN 4 THEN 'el primer DSCD-11-PL-2 ' || w WHEN 5 THEN 'qué opinas de ' || w ELSE w END"""


def _questions(spark, sf):
    w = F.col("w")
    m = F.col("turn") % 7
    q = F.when(m == 0, F.concat(F.lit("¿Qué partido es el más honrado? "), w)).when(m == 1, F.concat(F.lit("Último pleno de la legislatura 14 sobre "), w)).when(m == 2, F.concat(F.lit("Pleno 107, legislatura 14: "), w))
    q = q.when(m == 3, F.concat(F.lit("Vox y la vivienda: "), w)).when(m == 4, F.concat(F.lit("el primer DSCD-11-PL-2 "), w)).when(m == 5, F.concat(F.lit("qué opinas de "), w)).otherwise(w)
    c = table(spark, sf, "conversations").withColumn("w", F.split_part("text", F.lit(" "), F.lit(1)))
    return c.select("conv_id", "turn", q.alias("q"))


ASKED = f"q AS (SELECT conv_id, turn, {QUESTION} q FROM (SELECT *, split_part(text, ' ', 1) w FROM conversations)), k AS (SELECT *, {KEY.format('q')} k FROM q)"
SQL_PARTY = _case("k", tx.PARTY_RULES, _case("string_split(k, ' ')", tx.PARTY_WORDS, "NULL", "list_contains({0}, '{1}')"))


@query(f"""WITH {ASKED}, p AS (SELECT *, {SQL_PARTY} p FROM k) SELECT conv_id, turn, CASE WHEN {" OR ".join(f"regexp_matches(k, '{x}')" for x in tx.PARTISAN)} THEN 'opinion' WHEN p IS NOT NULL OR {" OR ".join(f"contains(k, '{h}')" for h in tx.POLITICAL)} THEN 'ok' ELSE 'off_topic' END veredicto FROM p""")
def guardrail(spark, sf):
    return _questions(spark, sf).select("conv_id", "turn", tx.verdict(F.col("q")).alias("veredicto"))


@query(f"""WITH {ASKED} SELECT conv_id, turn, CASE WHEN regexp_matches(k, '{tx.NEWEST}') THEN 'reciente' WHEN regexp_matches(k, '{tx.OLDEST}') THEN 'antiguo' END orden,
CAST(nullif(regexp_extract(k, '{tx.NUMBER}', 1), '') AS INTEGER) num, CAST(nullif(regexp_extract(k, '{tx.TERM}', 1), '') AS INTEGER) leg, {SQL_PARTY} partido, nullif(upper(regexp_extract(q, '(?i)DSCD-\\d+-PL-\\d+')), '') pleno, nullif(trim(CASE WHEN contains(q, ':') THEN substr(q, strpos(q, ':') + 1) ELSE q END, ' ¿?¡!.' || chr(9) || chr(10)), '') tema FROM k""")
def router(spark, sf):
    q = _questions(spark, sf)
    t = tx.temporal(F.col("q"))
    pleno = F.nullif(F.upper(F.regexp_extract("q", r"(?i)DSCD-\d+-PL-\d+", 0)), F.lit(""))
    return q.select("conv_id", "turn", t["orden"].alias("orden"), t["num"].alias("num"), t["leg"].alias("leg"), tx.detect_party(F.col("q")).alias("partido"), pleno.alias("pleno"), rec.asked_topic(F.col("q")).alias("tema"))


@query("""WITH a AS (SELECT conv_id, turn, 'Según [' || (turn % 5 + 1) || '] y [' || (conv_id % 9) || ', 3]' a FROM conversations), n AS (SELECT *, list_transform(regexp_extract_all(a, '\\[(\\d+)', 1), lambda x: CAST(x AS INTEGER)) n FROM a)
SELECT conv_id, turn, len(n) citas, len(list_filter(n, lambda x: x < 1 OR x > 4)) = 0 validas FROM n""".replace("\\\\", "\\"))
def citations_valid(spark, sf):
    """Citations [n] of an answer and whether all name one of its four sources."""
    a = F.format_string("Según [%d] y [%d, 3]", F.col("turn") % 5 + 1, F.col("conv_id") % 9)
    n = F.transform(F.regexp_extract_all(a, F.lit(r"\[(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(n).cast("long").alias("citas"), (F.size(F.array_except(n, F.sequence(F.lit(1), F.lit(4)))) == 0).alias("validas"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END partido, CASE WHEN event_id % 4 IN (2, 3) THEN NULL ELSE 'Ana ' || event_id END candidato, NULL::VARCHAR pleno, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'tema' END tema FROM events""")
def json_extract(spark, sf):
    """The four keys of the first JSON object in noisy text; empty values are null, and all are where it does not parse."""
    who = F.when(F.col("event_id") % 4 == 2, "").otherwise(F.concat(F.lit("Ana "), F.col("event_id").cast("string")))
    j = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("partido"), who.alias("candidato"), F.lit("").alias("pleno"), F.lit("tema").alias("tema")))
    noisy = F.concat(F.lit("Claro: ```json\n"), F.when(F.col("event_id") % 4 == 3, F.concat(F.lit("{sin comillas: "), j)).otherwise(j), F.lit("\n``` listo"))
    keys = ("partido", "candidato", "pleno", "tema")
    e = table(spark, sf, "events").select("event_id", F.from_json(F.regexp_extract(noisy, r"(?s)\{.*\}", 0), ", ".join(f"{k} string" for k in keys)).alias("j"))
    return e.select("event_id", *[F.nullif(F.col(f"j.{k}"), F.lit("")).alias(k) for k in keys])


@query(f"""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-záéíóúñ]+'), lambda w: length(w) > 3 AND NOT list_contains({rec.STOP_WORDS}, w))) w FROM benchmark) SELECT item_id, len(w) n, list_sort(w) palabras FROM t""")
def content_tokens(spark, sf):
    w = F.sort_array(rec.content_words(F.col("text")))
    return table(spark, sf, "benchmark").select("item_id", F.size(w).cast("long").alias("n"), w.alias("palabras"))


@query(f"""SELECT s_suppkey, trim(regexp_replace(regexp_replace(trim(n), '\\s*\\([^)]*\\)\\s*$', ''), '\\s+', ' ', 'g')) nombre, {KEY.format("trim(regexp_replace(regexp_replace(trim(n), '\\s*\\([^)]*\\)\\s*$', ''), '\\s+', ' ', 'g'))")} clave
FROM (SELECT s_suppkey, ' ' || s_name || '  Pérez-Núñez (Candidato ' || s_suppkey || ') ' n FROM supplier)""")
def canonical_speaker(spark, sf):
    n = F.concat(F.lit(" "), "s_name", F.lit("  Pérez-Núñez (Candidato "), F.col("s_suppkey").cast("string"), F.lit(") "))
    name = tx.speaker_name(n)
    return table(spark, sf, "supplier").select("s_suppkey", name.alias("nombre"), tx.norm_key(name).alias("clave"))


@query("""SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') seguro, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || page_id % 90 || 's' enlace, regexp_extract(url, '^https?://([^/]+)', 1) dominio, sha1(url) huella, md5(url) firma FROM pages""")
def links_and_digests(spark, sf):
    """Escaped text, a link to a second of a recording, and content digests."""
    url = F.col("url")
    link = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("t="), (F.col("page_id") % 90).cast("string"), F.lit("s"))
    return table(spark, sf, "pages").select("page_id", tx.escape(url).alias("seguro"), link.alias("enlace"), F.regexp_extract(url, "^https?://([^/]+)", 1).alias("dominio"), F.sha1(url).alias("huella"), F.md5(url).alias("firma"))


@query("""SELECT page_id, CASE WHEN regexp_matches(u, '^[A-Za-z0-9_-]{11}$') THEN u ELSE regexp_extract(u, '(?:v=|youtu\\.be/|/live/|/embed/)([A-Za-z0-9_-]{11})', 1) END vid FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN left(md5(url), 11) WHEN 1 THEN 'https://youtu.be/' || left(md5(url), 11) || '?t=3' ELSE url END u FROM pages)""".replace("\\\\", "\\"))
def video_ids(spark, sf):
    m = F.col("page_id") % 3
    v = F.left(F.md5("url"), F.lit(11))
    u = F.when(m == 0, v).when(m == 1, F.concat(F.lit("https://youtu.be/"), v, F.lit("?t=3"))).otherwise(F.col("url"))
    p = table(spark, sf, "pages").select("page_id", u.alias("u"))
    return p.select("page_id", F.when(F.rlike("u", F.lit("^[A-Za-z0-9_-]{11}$")), F.col("u")).otherwise(F.regexp_extract("u", r"(?:v=|youtu\.be/|/live/|/embed/)([A-Za-z0-9_-]{11})", 1)).alias("vid"))


@query("""SELECT c_custkey, regexp_matches(n, '^(Voz|Nueva voz) \\d+$') OR n IN ('', 'Interviniente') auto, len(list_filter(string_split(n, ' '), lambda t: NOT list_contains(['de', 'la', 'del', 'y'], lower(t)))) >= 2 AND len(list_filter(string_split(n, ' '), lambda t: NOT list_contains(['de', 'la', 'del', 'y'], lower(t)) AND length(t) < 3)) = 0 plausible
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Voz ' || c_custkey WHEN 1 THEN c_mktsegment || ' de la Torre' WHEN 2 THEN 'Interviniente' ELSE 'Jo ' || c_mktsegment END n FROM customer)""".replace("\\\\", "\\"))
def name_predicates(spark, sf):
    """Labels that a machine gave, and names of two words or more, all of three letters or more."""
    m = F.col("c_custkey") % 4
    n = F.when(m == 0, F.concat(F.lit("Voz "), F.col("c_custkey").cast("string"))).when(m == 1, F.concat("c_mktsegment", F.lit(" de la Torre"))).when(m == 2, "Interviniente").otherwise(F.concat(F.lit("Jo "), "c_mktsegment"))
    t = F.filter(F.split("n", " "), lambda w: ~F.lower(w).isin("de", "la", "del", "y"))
    c = table(spark, sf, "customer").select("c_custkey", n.alias("n"))
    return c.select("c_custkey", (F.rlike("n", F.lit(r"^(Voz|Nueva voz) \d+$")) | F.col("n").isin("", "Interviniente")).alias("auto"), ((F.size(t) >= 2) & F.forall(t, lambda w: F.length(w) >= 3)).alias("plausible"))


@query("""SELECT conv_id, turn, CASE WHEN len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) < 7 AND p IS NOT NULL THEN p || ' ' || text ELSE text END consulta FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) p FROM conversations)""".replace("\\\\", "\\"))
def follow_up(spark, sf):
    """A question of fewer than seven words takes the one before it along."""
    from pyspark.sql import Window

    p = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf, "conversations").withColumn("p", p)
    return c.select("conv_id", "turn", F.when((tx.word_count(F.col("text")) < 7) & F.col("p").isNotNull(), F.concat("p", F.lit(" "), "text")).otherwise(F.col("text")).alias("consulta"))


@query(r"""WITH t AS (SELECT doc_id, replace(text, chr(10), chr(10) || '## ') || chr(10) || '## Fin ![x](y.png) ' || text t FROM documents), s AS (SELECT doc_id, unnest(range(1, len(string_split(t, chr(10) || '## ')))) k, string_split(t, chr(10) || '## ') p FROM t),
b AS (SELECT doc_id, k, trim(regexp_replace(regexp_replace(p[k + 1], '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) b FROM s) SELECT doc_id, CAST(k AS INTEGER) seccion, left(b, 1400) texto, true generado FROM b WHERE length(b) > 120""")
def section_scan(spark, sf):
    """Sections of a written manual, without images, of more than 120 characters, cut at 1400 and marked as generated. Every line of a document is a section here."""
    t = F.concat(F.replace("text", F.lit("\n"), F.lit("\n## ")), F.lit("\n## Fin ![x](y.png) "), "text")
    s = table(spark, sf, "documents").select("doc_id", F.explode(rec.sections(t)).alias("s"))
    return s.select("doc_id", F.col("s.k").alias("seccion"), F.col("s.text").alias("texto"), F.lit(True).alias("generado"))


@query(r"""WITH p AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) t FROM pages) SELECT page_id, url, t texto, length(t) n FROM p WHERE length(t) >= 60""")
def page_scan(spark, sf):
    """A manual's pages with 60 characters of text or more, spaces squeezed."""
    p = table(spark, sf, "pages").select("page_id", "url", tx.squeeze(F.regexp_replace("html", "<[^>]*>", " ")).alias("texto"))
    return p.withColumn("n", F.length("texto").cast("long")).filter("n >= 60")


@query("""SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '(pleno|tion|ment)')""")
def title_filter(spark, sf):
    """Titles that a keyword of a list is in."""
    return table(spark, sf, "pages").filter(tx.any_of(F.lower("url"), ["pleno", "tion", "ment"])).select("page_id", "url")


@query(r"""WITH t AS (SELECT page_id, list_distinct(regexp_extract_all(s, '\b\d+(?:[.,]\d+)?\b') || list_transform(regexp_extract_all(s, '\b[A-Z][A-Za-z]{2,}\b'), lambda w: lower(w))) e FROM (SELECT page_id, regexp_replace(url, '[^\x00-\x7f]', '', 'g') || ' 3,5 Madrid' s FROM pages)) SELECT page_id, list_sort(e) entidades FROM t""")
def entities(spark, sf):
    """Numbers and capitalised words."""
    u = F.concat(F.regexp_replace("url", r"[^\x00-\x7f]", ""), F.lit(" 3,5 Madrid"))
    return table(spark, sf, "pages").select("page_id", F.sort_array(rec.entities(u)).alias("entidades"))


@query("""WITH r AS (SELECT min_by(url, page_id) url, min(page_id) page_id, h FROM (SELECT page_id, url, sha1(url) h, 100 + page_id * 37 % 300 w, 80 + page_id * 53 % 200 hh, length(html) * 8 b FROM pages) WHERE w >= 200 AND hh >= 120 AND b >= 8192 GROUP BY h)
SELECT page_id, url, h huella FROM r WHERE page_id % 10 <> 0""")
def image_filter(spark, sf):
    """Pictures of a manual large enough to be described, each content once, without those described already."""
    p = table(spark, sf, "pages")
    images = p.select("page_id", "url", F.sha1("url").alias("huella"), (100 + F.col("page_id") * 37 % 300).alias("width"), (80 + F.col("page_id") * 53 % 200).alias("height"), (F.length("html") * 8).alias("bytes"))
    return sections.new_images(images, F.col("page_id") % 10 == 0, "page_id").select("page_id", "url", "huella")
