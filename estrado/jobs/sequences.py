"""Folds, alignments and fuzzy links over the given tables: no SQL says these, the tests compare them with plain versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import record as rec
from ..functions import text as tx
from ..functions.vector import dot
from ..operators import lexicon, names, turns
from ..operators import sequences as op
from ..operators.components import written
from ..sources.tables import segments, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def said_by(sql: str):
    """A query that SQL can express, for what its input was made of is known."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def spoken(spark, sf):
    """Segments with text, from conversations: a turn a second."""
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("pleno_id"), F.col("turn").alias("seg_id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), F.col("role").alias("speaker"), "text")


@query
def chunk_transcript(spark, sf):
    return op.chunks(spoken(spark, sf), by_speaker=False)


@query
def chunk_by_speaker(spark, sf):
    return op.chunks(segments(spark, sf), most=30)


@query
def accumulate_windows(spark, sf):
    return op.windows_of(spoken(spark, sf))


@query
def sentence_pack(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return op.pack_sentences(d, "doc_id", "s")


@query
def debounce(spark, sf):
    return op.debounced(segments(spark, sf).select("pleno_id", "seg_id", "start"), gap=7200.0)


@said_by("""WITH c AS (SELECT user_id pleno_id, event_id seg_id, event_type IN ('signup', 'purchase') call, round(value * 60) > 1200 named, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts) // 1, event_id) n FROM events), i AS (SELECT *, n - row_number() OVER (PARTITION BY pleno_id, call AND named ORDER BY n) isla FROM c),
h AS (SELECT *, call AND named AND row_number() OVER (PARTITION BY pleno_id, call AND named, isla ORDER BY n) % 2 = 1 releva FROM i), t AS (SELECT *, releva OR (call AND coalesce(lag(releva) OVER (PARTITION BY pleno_id ORDER BY n), false)) mesa, count(*) FILTER (releva) OVER (PARTITION BY pleno_id ORDER BY n) relevos FROM h)
SELECT pleno_id, seg_id, CASE WHEN mesa THEN -1 ELSE CAST(relevos - 1 AS INTEGER) END turno FROM t""")
def handover_turns(spark, sf):
    """Calls hand over where they name somebody, here the longer ones; the chair is -1 before the first and in each call."""
    return op.handovers(segments(spark, sf), "^(signup|purchase)$", F.col("end") - F.col("start") > 1200)


@query
def align_nw(spark, sf):
    """What was heard against what was written: every fifth name is missing and some are misspelt."""
    t = segments(spark, sf)
    n = F.row_number().over(Window.partitionBy("pleno_id").orderBy("start", "seg_id")).cast("long")
    a = t.select("pleno_id", n.alias("pos"), F.col("speaker").alias("name"))
    b = a.filter("pos % 5 <> 0").withColumn("name", F.when(F.col("pos") % 7 == 0, F.concat("name", F.lit("s"))).otherwise(F.col("name")))
    return op.align_sessions(a, b)


WORDS = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '([0-9])[.]([0-9][0-9][0-9])\\b', '\\1\\2', 'g'), '[^0-9a-zñ\\s]', ' ', 'g'), '\\s+', ' ', 'g'))".replace("\\\\", "\\")


def _heard(spark, sf, step: int):
    """Benchmark passages, and the same without every step-th word."""
    d = table(spark, sf, "benchmark")
    w = rec.spoken_words(F.col("text"))
    return d.withColumn("hyp", F.array_join(F.filter(w, lambda x, i: i % step != step - 1), " "))


@said_by(f"WITH w AS (SELECT item_id, {WORDS} t FROM benchmark) SELECT item_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END words, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END // 9 edits FROM w")
def wer_by_document(spark, sf):
    """A text against itself without every ninth word, by the words that error rates count: leaving out n words takes n edits, no fewer."""
    return op.word_errors(_heard(spark, sf, 9), "item_id", "text", "hyp").select("item_id", "words", "edits")


@said_by(f"WITH w AS (SELECT {WORDS} t FROM benchmark), n AS (SELECT CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END n FROM w) SELECT count(*) pares, CAST(sum(n) AS BIGINT) palabras, CAST(sum(n // 9) AS BIGINT) errores, round(sum(n // 9) * 1.0 / sum(n), 6) wer FROM n")
def wer_micro(spark, sf):
    """All errors over all words."""
    e = op.word_errors(_heard(spark, sf, 9), "item_id", "text", "hyp")
    return e.agg(F.count(F.lit(1)).alias("pares"), F.sum("words").alias("palabras"), F.sum("edits").alias("errores"), F.round(F.sum("edits") / F.sum("words"), 6).alias("wer"))


@query
def wer_substitutions(spark, sf):
    """The thirty commonest replaced words, without numbers: every seventh word is heard with its beginning twice."""
    w = rec.spoken_words(F.col("text"))
    heard = F.transform(w, lambda x, i: F.when(i % 7 == 6, F.concat(F.left(x, F.lit(2)), x)).otherwise(x))
    e = op.word_errors(table(spark, sf, "benchmark").withColumn("hyp", F.array_join(heard, " ")), "item_id", "text", "hyp")
    s = e.select(F.explode("subs").alias("s")).select("s.ref", "s.hyp").filter(~F.rlike("ref", F.lit(r"^\\d+$")) & ~F.rlike("hyp", F.lit(r"^\\d+$")))
    return s.groupBy("hyp", "ref").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hyp", "ref").limit(30)


@said_by("WITH s AS (SELECT DISTINCT replace(s_name, 'r', '') || ' de la' name, s_name canon FROM supplier) SELECT name, canon, round(2.0 * (length(canon) - len(regexp_extract_all(canon, 'r'))) / (2 * length(canon) - len(regexp_extract_all(canon, 'r'))), 6) sim FROM s")
def fuzzy_names(spark, sf):
    """Suppliers' names without their r: each is found again, as no other name shares its number."""
    s = table(spark, sf, "supplier")
    heard = s.select(F.concat(F.replace("s_name", F.lit("r"), F.lit("")), F.lit(" de la")).alias("name"))
    return names.fuzzy_link(heard, s.select(F.col("s_name").alias("canon"), F.col("s_nationkey").alias("n"))).drop("party")


@query
def glossary_fix(spark, sf):
    """What was said, repaired by sound: the terms are the commonest long words and pairs of the benchmark's passages, one alias is exact."""
    w = rec.spoken_words(F.col("text"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(w, i), F.try_element_at(w, i + 1)))
    t = table(spark, sf, "benchmark").select(F.explode(F.concat(w, pairs)).alias("term")).filter(F.length("term").between(9, 16))
    terms = t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(60)
    aliases = spark.createDataFrame([("the", "el"), ("undder", "y de")], "key string, canon string")
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return lexicon.repaired(c, "id", "text", terms, aliases).select("id", "text", F.size("cambios").alias("cambios"))


@query
def voice_exemplar_buckets(spark, sf):
    """A voice's spans of speech gathered to exemplars of twelve minutes."""
    s = segments(spark, sf).select(F.concat_ws("-", "pleno_id", "speaker").alias("persona"), (F.col("start") / 60).alias("start"), (F.col("end") / 60).alias("end"))
    return op.exemplar_buckets(s)


@query
def voice_store(spark, sf):
    """Voiceprints that grow from session to session: each sixteen vectors are a voice, eight of each of two sessions, the cap at eight exemplars."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("Ana "), F.floor(F.col("vec_id") / 16).cast("string")).alias("persona"), (F.floor(F.col("vec_id") / 8) % 2).alias("sesion"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    new = e.groupBy("persona", "sesion").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "vec"))), lambda x: x["vec"]).alias("vecs")).withColumn("party", F.when(F.col("sesion") == 0, "PP").otherwise(""))
    store = spark.createDataFrame([], "persona string, n int, party string, vecs array<array<double>>")
    for session in (0, 1):
        store = op.enrolled(store, new.filter(F.col("sesion") == session).select("persona", "party", "vecs"))
    return store.select("persona", "n", "party", F.size("vecs").alias("huellas"), F.round(F.aggregate(F.flatten("vecs"), F.lit(0.0), lambda a, x: a + x), 5).alias("suma"))


@query
def voice_exemplars(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("persona"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    # a person's exemplars of a session of five hundred voices: some fifty, which the cap joins to eight
    e = e.withColumn("persona", F.concat_ws("-", "persona", F.floor(F.col("id") / 500).cast("string")))
    return op.exemplar_caps(e).select("persona", "n", F.transform("vecs", lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6)).alias("norms"))


@query
def voice_components(spark, sf):
    """Voices joined by likeness: all pairs within a label whose cosine is large, then components. A vector is a voice's print, its label the session."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("session"), F.col("embedding").alias("vec"))
    return op.same_voice(op.voice_links(e, 0.15), e.select(F.col("id").alias("node")))


@query
def topics_kmeans(spark, sf):
    """Topics by clustering vectors, each with the commonest label inside."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    p = KMeans(k=10, seed=1, maxIter=10).fit(e).transform(e)
    n = p.groupBy("prediction", "label").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("prediction").orderBy(F.desc("n"), "label"))
    return n.withColumn("k", k).filter("k = 1").select(F.col("prediction").alias("tema"), "label", "n")


@query
def chapters(spark, sf):
    """Chapters of a recording: cuts where neighbours are unlike, none less than three windows after the last one kept or the beginning."""
    e = table(spark, sf, "embeddings").select((F.floor(F.col("vec_id") / 50)).alias("pleno_id"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    w, all_ = Window.partitionBy("pleno_id").orderBy("id"), Window.partitionBy("pleno_id")
    s = e.withColumn("pos", F.row_number().over(w) - 1).withColumn("sim", dot("vec", F.lag("vec").over(w))).drop("vec")
    cut = s.withColumn("m", F.avg("sim").over(all_) - 0.9 * F.stddev_pop("sim").over(all_)).filter("pos = 0 or sim < m")
    return op.debounced(cut.select("pleno_id", F.col("id").alias("seg_id"), F.col("pos").cast("double").alias("start")), gap=3.0).select("pleno_id", "seg_id", F.col("start").cast("int").alias("ventana"))


@query
def agenda_called(spark, sf):
    """Points that the chair calls ('punto número tres'), with a title from what follows."""
    n = F.element_at(F.array(*[F.lit(x) for x in ("uno", "dos", "tercero", "4", "décimo")]), (F.col("seg_id") % 5 + 1).cast("int"))
    t = F.when(F.col("seg_id") % 4 == 0, F.concat(F.lit("Pasamos al punto número "), n, F.lit(". "), "text")).otherwise(F.col("text"))
    return turns.called_points(spoken(spark, sf).withColumn("text", t).select("pleno_id", "seg_id", "start", "text"))


TOPIC_KEY = r"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^0-9a-z\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


@said_by(f"""WITH w AS (SELECT source, doc_id, list_filter(string_split({TOPIC_KEY}, ' '), lambda x: length(x) > 3 AND NOT list_contains({rec.TOPIC_STOP_WORDS}, x)) w FROM documents),
t AS (SELECT source, doc_id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) t FROM w), f AS (SELECT source, t, count(*) tf, count(DISTINCT doc_id) df FROM t GROUP BY 1, 2),
g AS (SELECT t, sum(tf) f FROM f GROUP BY 1 HAVING sum(df) >= 2), z AS (SELECT source, sum(tf) size FROM f GROUP BY 1), s AS (SELECT f.source, f.t, round(tf / size * ln(1 + (SELECT avg(size) FROM z) / g.f), 8) peso FROM f JOIN g ON f.t = g.t JOIN z ON z.source IS NOT DISTINCT FROM f.source),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY peso DESC, t) AS INTEGER) rank FROM s) SELECT source, t, peso, rank FROM r WHERE rank <= 10""")
def topic_words(spark, sf):
    """Class-based tf-idf of one- and two-word terms in at least two documents, without stop words, ten for each source.

    A document's terms are sorted, so that the first of equal ones counts the document; counts by (source, term) are combined before the only shuffle
    of terms, and a term's sources travel together as one row.
    """
    keep = lambda w: (F.length(w) > 3) & ~w.isin(*rec.TOPIC_STOP_WORDS)
    d = table(spark, sf, "documents").select("source", F.filter(F.split(tx.norm_key(F.col("text")), " "), keep).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    two = F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))
    d = d.select("source", F.array_sort(F.concat("w", two)).alias("t"))
    terms = F.arrays_zip(F.col("t").alias("t"), F.concat(F.array(F.lit(None).cast("string")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))).alias("before"))
    e = d.select("source", F.explode(terms).alias("x")).filter("x.t is not null").select("source", F.col("x.t").alias("t"), (~F.col("x.t").eqNullSafe(F.col("x.before"))).cast("int").alias("doc"))
    tf = written(e.groupBy("source", "t").agg(F.count(F.lit(1)).alias("tf"), F.sum("doc").alias("df")), "terms")
    size = tf.groupBy("source").agg(F.sum("tf").alias("size"))
    mean = F.lit(float(size.agg(F.avg("size")).first()[0] or 0.0))
    all_ = tf.groupBy("t").agg(F.sum("tf").alias("f"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "tf")).alias("s")).filter("df >= 2")
    s = all_.select("t", "f", F.explode("s").alias("s")).select("t", "f", "s.*").join(size.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    s = s.withColumn("peso", F.round(F.col("tf") / F.col("size") * F.log(1 + mean / F.col("f")), 8))
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("peso"), "t"))
    return s.withColumn("rank", k).filter("rank <= 10").select("source", "t", "peso", "rank")
