"""Readers of the record's files, tolerant as its producers need, and writers of the same shapes.

Every reader takes a path that Spark opens and an explicit schema; what does not parse goes to a table of rejects or is
dropped, as the shape says, and never stops a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOTES = "array<struct<emitidos:int,a_favor:int,en_contra:int,abstenciones:int>>"
SPEECHES = "array<struct<speaker:string,party:string,role:string,topic:string,text:string>>"
SESSION = f"id string, legislatura string, fecha string, tema_sesion string, votaciones {VOTES}, n_intervenciones int, interventions {SPEECHES}, _corrupt string"
SEGMENT = "struct<id:int,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,speaker:string,overlap:boolean,name:string,party:string>"
TRANSCRIPT = f"audio string, language string, duration double, model string, segments array<{SEGMENT}>"
VISION = "id string, punto int, error string, recuento struct<a_favor:int,en_contra:int,abstencion:int>, sin_voto int, asientos_a_revisar array<int>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(path)


def sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Session documents, and the files that are none: (id, legislatura, fecha, ..., interventions), (file, id, raw).

    The id falls back to the file's stem, a term that is no number is 0, strings are trimmed and never null.
    """
    raw = _json(spark, path, SESSION).withColumn("file", F.col("_metadata.file_name"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    good = raw.filter("_corrupt is null").select(
        F.coalesce(F.nullif(text(F.col("id")), F.lit("")), F.regexp_replace("file", r"\.json$", "")).alias("pleno_id"),
        F.coalesce(F.col("legislatura").try_cast("int"), F.lit(0)).alias("legislatura"),
        text(F.col("fecha")).alias("fecha"),
        text(F.col("tema_sesion")).alias("tema_sesion"),
        F.coalesce("votaciones", F.expr("array()")).alias("votaciones"),
        F.coalesce("interventions", F.expr("array()")).alias("interventions"),
    )
    return good, raw.filter("_corrupt is not null").select("file", "id", F.col("_corrupt").alias("raw"))


def interventions(docs: DataFrame) -> DataFrame:
    """A row for each intervention, numbered from 0."""
    e = docs.select("pleno_id", "legislatura", "fecha", F.posexplode("interventions").alias("idx", "i"))
    return e.select("pleno_id", "legislatura", "fecha", "idx", *[F.trim(F.coalesce(F.col(f"i.{c}"), F.lit(""))).alias(c) for c in ("speaker", "party", "role", "topic", "text")])


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each segment of each transcript; the session is the file's stem."""
    t = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("pleno_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return t.select("pleno_id", F.posexplode("segments").alias("seg_id", "s")).select("pleno_id", "seg_id", "s.start", "s.end", "s.text", "s.speaker", "s.overlap", "s.name", "s.party")


def roster(spark: SparkSession, path: str) -> DataFrame:
    """(nombre, grupo, cargo) of a CSV with a header in any case, with or without a byte order mark; rows without a name go."""
    d = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    d = d.toDF(*[c.replace("﻿", "").strip().lower() for c in d.columns])
    col = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in d.columns else F.lit("")
    return d.select(col("nombre").alias("nombre"), col("grupo").alias("grupo"), col("cargo").alias("cargo")).filter("nombre <> ''")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(legislatura or null, key, sigla): of equal keys the last row of the file; rows without a correction go."""
    from ..functions.record import registry_name as norm_key

    d = spark.read.option("header", True).csv(path).withColumn("_n", F.monotonically_increasing_id())
    d = d.select(F.col("legislatura").try_cast("int").alias("legislatura"), norm_key(F.col("speaker")).alias("key"), F.trim("party_correcto").alias("sigla"), "_n").filter("sigla <> ''")
    last = F.row_number().over(Window.partitionBy("legislatura", "key").orderBy(F.desc("_n")))
    return d.withColumn("_k", last).filter("_k = 1").drop("_k", "_n")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(legislatura, name, key, sigla, canon) of a JSON map term -> name -> [sigla, canonical name]."""
    from ..functions.record import registry_name as norm_key

    raw = spark.read.option("wholetext", True).text(path).select(F.split("value", r"(?<=\})\n+(?=\{)").alias("parts")).select(F.explode("parts").alias("value"))
    raw = raw.select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    d = raw.select(F.explode("m").alias("leg", "names")).select("leg", F.explode("names").alias("name", "v"))
    return d.select(F.col("leg").try_cast("int").alias("legislatura"), "name", norm_key(F.col("name")).alias("key"), F.try_element_at("v", F.lit(1)).alias("sigla"), F.try_element_at("v", F.lit(2)).alias("canon"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines that are no comment: agendas, glossaries."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#')")


def glossary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms, the longest first to match; and aliases (key, canon) of lines WRONG=RIGHT, keyed by letters and digits."""
    l = lines(spark, path)
    terms = l.filter("not contains(line, '=')").select(F.col("line").alias("term"), F.length("line").alias("n"))
    pair = l.filter("contains(line, '=')").select(F.split_part("line", F.lit("="), F.lit(1)).alias("bad"), F.trim(F.split_part("line", F.lit("="), F.lit(2))).alias("canon"))
    return terms, pair.select(F.regexp_replace(F.lower("bad"), r"[^\p{L}\p{N}]", "").alias("key"), "canon").filter("key <> '' and canon <> ''")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(sec, text) of lines [mm:ss] text."""
    p = r"^\[(\d+):(\d{2})\]\s*(.*)$"
    d = spark.read.text(path).filter(F.rlike("value", F.lit(p)))
    return d.select((F.regexp_extract("value", p, 1).cast("int") * 60 + F.regexp_extract("value", p, 2).cast("int")).alias("sec"), F.regexp_extract("value", p, 3).alias("text"))


def vision_votes(spark: SparkSession, path: str) -> DataFrame:
    """Counted votes; files that report an error hold none."""
    return spark.read.schema(VISION).option("multiLine", True).json(path).filter("error is null and recuento is not null").select("id", "punto", "recuento.*", "sin_voto", F.size(F.coalesce("asientos_a_revisar", F.expr("array()"))).alias("a_revisar"))


def voiceprints(spark: SparkSession, path: str) -> DataFrame:
    """(persona, exemplar, vec, party) of a map of people; an old file's single vec is one exemplar."""
    kind = "map<string,struct<vecs:array<array<float>>,vec:array<float>,n:int,party:string>>"
    d = spark.read.option("wholetext", True).text(path).select(F.from_json("value", kind).alias("m")).select(F.explode("m").alias("persona", "v"))
    vecs = F.coalesce("v.vecs", F.when(F.col("v.vec").isNotNull(), F.array("v.vec")), F.expr("array()"))
    return d.select("persona", F.col("v.party").alias("party"), F.posexplode(vecs).alias("exemplar", "vec"))


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines file; lines that do not parse are not counted."""
    return spark.read.schema("ts string, q string, util boolean, manual string").option("mode", "DROPMALFORMED").json(path)


def write_sessions(iv: DataFrame, path: str) -> None:
    """Session documents from interventions(pleno_id, legislatura, fecha, idx, ...): a line each, interventions in their order."""
    i = F.struct("idx", "speaker", "party", "role", "topic", "text")
    g = iv.groupBy(F.col("pleno_id").alias("id"), "legislatura", "fecha").agg(F.sort_array(F.collect_list(i)).alias("i"), F.count(F.lit(1)).alias("n_intervenciones"))
    g.select("id", "legislatura", "fecha", "n_intervenciones", F.transform("i", lambda x: x.dropFields("idx")).alias("interventions")).write.json(path)


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """(sha, desc, manual, page, file) of a JSON map of descriptions by content digest."""
    kind = "map<string,struct<desc:string,manual:string,page:int,file:string>>"
    d = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", kind)).alias("sha", "v"))
    return d.select("sha", "v.desc", "v.manual", "v.page", F.coalesce("v.file", F.lit("")).alias("file"))


def tutorials(spark: SparkSession, folder: str, known: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(vid, title, seg_id, start, end, text) of the transcripts of tutorials in a folder, a video once.

    A file's stem is a video's id of eleven characters, its title stands in <id>.title.txt; known maps other stems to (id, title). Other files are none. Of two
    files of one video the last stem in order stays.
    """
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    t = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).select(stem.alias("stem"), "segments")
    k = spark.createDataFrame([(a, *b) for a, b in (known or {}).items()], "stem string, known string, name string")
    t = t.join(F.broadcast(k), "stem", "left").withColumn("vid", F.coalesce("known", F.when(F.length("stem") == 11, F.col("stem")))).filter("vid is not null")  # a few legacy names
    first = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("stem")))
    t = t.withColumn("k", first).filter("k = 1")
    names = spark.read.option("wholetext", True).option("pathGlobFilter", "*.title.txt").text(folder).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.title\.txt$", "").alias("stem"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("said"))
    t = t.join(names, "stem", "left").select("vid", F.coalesce("name", "said", F.lit("Tutorial (vídeo)")).alias("title"), F.posexplode("segments").alias("seg_id", "s"))
    return t.select("vid", "title", "seg_id", "s.start", "s.end", "s.text")


def expand(spark: SparkSession, inputs: list[str], suffix: str) -> list[str]:
    """Files, folders and globs as files that end with suffix, each once: in the order given, within a folder or glob by name."""
    out: dict[str, None] = {}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for i in inputs:
        p = jvm.org.apache.hadoop.fs.Path(i)
        fs = p.getFileSystem(conf)
        for found in fs.globStatus(p) or []:
            files = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
            for f in sorted(x.getPath().toString() for x in files if x.isFile()):
                if f.lower().endswith(suffix):
                    out.setdefault(f)
    return list(out)


def vocabulary(terms: DataFrame, roster_: DataFrame) -> DataFrame:
    """(term) of a glossary's terms(term) and a roster's names(name), each once."""
    return terms.select("term").union(roster_.select(F.col("name"))).filter("term is not null and term <> ''").distinct()


def write_roster(names: DataFrame, path: str) -> None:
    """A roster (name, party, n) as JSON lines."""
    names.select("name", "party", "n").write.json(path)


def roster_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, party string, n long").json(path)


def write_registry(reg: DataFrame, path: str) -> None:
    """(legislatura, name, sigla, canon) as a JSON map term -> name -> [sigla, canonical name], a line for each term's part."""
    by = reg.groupBy("legislatura").agg(F.map_from_entries(F.collect_list(F.struct("name", F.array("sigla", "canon")))).alias("names"))
    by.select(F.to_json(F.create_map(F.col("legislatura").cast("string"), F.col("names"))).alias("value")).write.text(path)


def write_captions(seg: DataFrame, path: str) -> None:
    """Captions of every session in a folder of its own: segments(pleno_id, seg_id, start, end, text), numbered in their order."""
    from ..functions.record import caption

    n = F.row_number().over(Window.partitionBy("pleno_id").orderBy("start", "seg_id"))
    c = seg.select("pleno_id", "start", "seg_id", n.alias("n"), "end", "text")
    c = c.select("pleno_id", "n", caption(F.col("n"), F.col("start"), F.col("end"), F.col("text")).alias("value"))
    c.repartition("pleno_id").sortWithinPartitions("pleno_id", "n").select("pleno_id", "value").write.partitionBy("pleno_id").text(path)


def write_plain(seg: DataFrame, path: str) -> None:
    """The words alone of every session, a segment a line."""
    c = seg.select("pleno_id", "start", "seg_id", F.trim(F.coalesce("text", F.lit(""))).alias("value")).filter("value <> ''")
    c.repartition("pleno_id").sortWithinPartitions("pleno_id", "start", "seg_id").select("pleno_id", "value").write.partitionBy("pleno_id").text(path)
