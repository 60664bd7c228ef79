"""Exact profiles (fichas) of speakers, parties and sessions.

Every function takes interventions (pleno_id, speaker, party, role, topic, legislatura, fecha_iso, n_words)
and groups them all at once: a row for each key, in place of a query for each key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import written


def substantive() -> Column:
    """Not the chair's: neither by role nor, in old records, by party. Null counts as empty."""
    return (F.lower(F.coalesce("role", F.lit(""))) != "presidencia") & (F.coalesce("party", F.lit("")) != "Presidencia")


def head(iv: DataFrame, by: str) -> DataFrame:
    """Counts, distinct sessions, first and last date and words of each key; the chair's rows count."""
    return iv.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("pleno_id").alias("n_plenos"),
        F.min("fecha_iso").alias("desde"),
        F.max("fecha_iso").alias("hasta"),
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("palabras"),
    )


def top_facets(iv: DataFrame, by: str, facet: str, k: int) -> DataFrame:
    """The k most frequent non-empty values of facet for each key; ties by value."""
    n = iv.filter(F.coalesce(F.col(facet), F.lit("")) != "").groupBy(by, facet).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), facet))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k)


def recent_sessions(iv: DataFrame, by: str, k: int = 8) -> DataFrame:
    d = iv.select(by, "pleno_id", "fecha_iso").distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("fecha_iso"), F.desc("pleno_id")))
    return d.withColumn("rank", rank).filter(F.col("rank") <= k)


def evolution(iv: DataFrame, period: str = "legislatura", topic: str = "topic", k: int = 3) -> DataFrame:
    """By period: counts, distinct sessions, first and last date, and the k most frequent topics as one list.

    Rows are counted once by (period, session, topic); totals, distinct sessions and topics all come from that.
    """
    by = iv.groupBy(period, "pleno_id", topic).agg(F.count(F.lit(1)).alias("n"), F.min("fecha_iso").alias("desde"), F.max("fecha_iso").alias("hasta"))
    return _evolved(by, period, topic, k)


def evolution_by_head(speeches: DataFrame, heads: DataFrame, period: str = "legislatura", topic: str = "topic", k: int = 3) -> DataFrame:
    """evolution() where date and topic belong to the session: speeches(pleno_id) are counted by session before they meet heads(pleno_id, fecha_iso, period, topic), so the join is of sessions."""
    n = speeches.groupBy("pleno_id").agg(F.count(F.lit(1)).alias("n"))
    by = n.join(heads.select("pleno_id", period, topic, F.col("fecha_iso").alias("desde"), F.col("fecha_iso").alias("hasta")), "pleno_id")
    return _evolved(by, period, topic, k)


def _evolved(by: DataFrame, period: str, topic: str, k: int) -> DataFrame:
    sessions = by.groupBy(period, "pleno_id").agg(F.sum("n").alias("n"), F.min("desde").alias("desde"), F.max("hasta").alias("hasta"))
    total = sessions.groupBy(period).agg(F.sum("n").alias("n"), F.count("pleno_id").alias("n_plenos"), F.min("desde").alias("desde"), F.max("hasta").alias("hasta"))
    topics = by.filter(F.coalesce(F.col(topic), F.lit("")) != "").groupBy(period, topic).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(period).orderBy(F.desc("n"), topic))
    return total.join(_listed(topics.withColumn("rank", rank).filter(F.col("rank") <= k), period, F.col(topic), "temas"), period, "left")


def _listed(top: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """The ranked rows of each key, at most some tens, as one text."""
    t = top.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", value.alias("v")))).alias("t"))
    return t.select(by, F.array_join(F.transform("t", lambda x: x["v"]), "|").alias(name))


def party(iv: DataFrame, k: int = 10) -> DataFrame:
    """By party, without (con_mesa false) and with the chair's rows: counts, sessions, speakers, dates, words, and its k commonest speakers and topics.

    Rows are counted once by (party, speaker, topic, session) and whether they are the chair's; everything else comes from that table. A party without speakers or topics has null lists.
    """
    n = F.count(F.lit(1)).alias("n")
    c = iv.groupBy("party", "speaker", "topic", "pleno_id", (~substantive()).alias("chair")).agg(n, F.min("fecha_iso").alias("desde"), F.max("fecha_iso").alias("hasta"), F.sum("n_words").alias("palabras"))
    c = written(c, "party_counts").withColumn("con_mesa", F.explode(F.when(F.col("chair"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    by = ["con_mesa", "party"]
    total = c.groupBy(*by).agg(
        F.sum("n").alias("n"), F.countDistinct("pleno_id").alias("n_plenos"), F.countDistinct("speaker").alias("oradores"), F.min("desde").alias("desde"), F.max("hasta").alias("hasta"), F.coalesce(F.sum("palabras"), F.lit(0)).alias("palabras")
    )
    for facet, name in (("speaker", "oradores_top"), ("topic", "temas")):
        f = c.filter(F.coalesce(F.col(facet), F.lit("")) != "").groupBy(*by, facet).agg(F.sum("n").alias("n"))
        f = f.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), facet))).filter(F.col("rank") <= k)
        f = f.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(facet).alias("v")))), lambda x: x["v"]), "|").alias(name))
        total = total.alias("t").join(f.alias("f"), (F.col("t.con_mesa") == F.col("f.con_mesa")) & F.col("t.party").eqNullSafe(F.col("f.party")), "left").select("t.*", f"f.{name}")
    return total


VOTES = "array<struct<a_favor:int,en_contra:int,abstenciones:int>>"


def session(heads: DataFrame, iv: DataFrame, k: int = 10) -> DataFrame:
    """Every session of heads(pleno_id, fecha, legislatura, tema_sesion, votaciones_json) with what was said in it.

    The rows of a session are first counted by speaker and by (party, topic); all else comes from those counts. A session without rows, or
    whose votes do not parse, has empty lists. Rows without a column topic have the session's own, which is taken from its head after the counts.
    """
    own = "topic" not in iv.columns
    iv = iv.withColumn("topic", F.lit("")) if own else iv
    words = iv.filter(substantive()).groupBy("pleno_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    rank = F.row_number().over(Window.partitionBy("pleno_id").orderBy(F.desc("w"), "speaker"))
    top = _listed(words.withColumn("rank", rank).filter(F.col("rank") <= k), "pleno_id", F.concat_ws(":", "speaker", "n", "w"), "oradores")
    pairs = iv.groupBy("pleno_id", "party", "topic").agg(F.count(F.lit(1)).alias("n"))
    by_party = pairs.groupBy("pleno_id", "party").agg(F.sum("n").alias("n"), F.collect_set(F.nullif("topic", F.lit(""))).alias("temas"))
    row = F.when(F.coalesce("party", F.lit("")) != "", F.struct((-F.col("n")).alias("o"), "party", "n"))
    facts = by_party.groupBy("pleno_id").agg(F.sum("n").alias("intervenciones"), F.array_sort(F.collect_list(row)).alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("temas")))).alias("t"))
    split = F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["party"], x["n"].cast("string"))), "|"))
    topics = F.when(F.col("intervenciones") > 0, F.nullif("tema_sesion", F.lit(""))) if own else F.when(F.size("t") > 0, F.array_join("t", "|"))
    votes = F.coalesce(F.from_json("votaciones_json", VOTES), F.array().cast(VOTES))
    said = F.array_join(F.transform(votes, lambda v: F.concat_ws("-", *[v[c].cast("string") for c in ("a_favor", "en_contra", "abstenciones")])), "|")
    out = heads.join(facts, "pleno_id", "left").join(top, "pleno_id", "left")
    return out.select("pleno_id", "fecha", "legislatura", "tema_sesion", F.coalesce("intervenciones", F.lit(0)).alias("intervenciones"), split.alias("reparto"), "oradores", topics.alias("temas"), F.size(votes).alias("n_votaciones"), said.alias("votaciones"))


def quality(iv: DataFrame, voted: DataFrame) -> DataFrame:
    """By term: counts of roles, shares without party and with topic, deputies of several parties; of voted(legislatura, voted), a row for each session, the share."""
    deputy = F.col("role") == "diputado"
    by = iv.groupBy("legislatura", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "presidencia").alias("chair"), F.count_if(deputy).alias("deputies"), F.count_if(deputy & (F.col("party") == "")).alias("bare"), F.count_if(F.coalesce("topic", F.lit("")) != "").alias("topic"),
        F.countDistinct(F.when(deputy, F.nullif("party", F.lit("")))).alias("parties"),
    )
    pct = lambda part, of: F.round(100 * F.sum(part) / F.greatest(F.sum(of), F.lit(1)), 2)
    facts = by.groupBy("legislatura").agg(
        F.sum("n").alias("n"), F.sum("chair").alias("presidencia"), F.sum("deputies").alias("diputados"), pct("bare", "deputies").alias("pct_sin_partido"), pct("topic", "n").alias("pct_con_tema"), F.count_if(F.col("parties") > 1).alias("varios")
    )
    v = voted.groupBy("legislatura").agg(F.round(100 * F.count_if(F.col("voted")) / F.count(F.lit(1)), 2).alias("pct_con_votos"))
    return facts.join(v, "legislatura", "left")


def prune_stats(iv: DataFrame, thresholds: list[int]) -> DataFrame:
    """How many interventions and words each threshold on words would drop, the chair's included."""
    drop = [(~substantive()) | (F.col("n_words") < t) for t in thresholds]
    one = iv.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(d).alias(f"n{t}") for t, d in zip(thresholds, drop)],
        *[F.coalesce(F.sum(F.when(d, F.col("n_words"))), F.lit(0)).alias(f"w{t}") for t, d in zip(thresholds, drop)],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("umbral"), F.col(f"n{t}").alias("quitadas"), F.col(f"w{t}").alias("palabras")) for t in thresholds]))
    return one.select("total", rows.alias("r")).select("r.*", "total", F.round(100 * F.col("r.quitadas") / F.col("total"), 2).alias("pct"))


def where(**conditions) -> Column:
    """All of the conditions that are given: a value is equality, a list membership. None and "" are no condition."""
    given = [F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in conditions.items() if v not in (None, "", [], ())]
    return reduce(lambda a, b: a & b, given, F.lit(True))


#: An entity's kind and the column it filters.
ENTITY_COLUMN = {"candidato": "speaker", "partido": "party", "pleno": "pleno_id"}


def edge_session(iv: DataFrame, latest: bool, by: str | None = None) -> DataFrame:
    """The latest or earliest dated session, of all or of each value of by; ties by session."""
    d = iv.filter(F.coalesce("fecha_iso", F.lit("")) != "")
    pick = (F.max if latest else F.min)(F.struct("fecha_iso", "pleno_id")).alias("s")
    out = (d.groupBy(by) if by else d).agg(pick)
    return out.select(*([by] if by else []), "s.fecha_iso", "s.pleno_id")


def by_number(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """asked(leg, num) with pleno_id, of sessions(pleno_id, legislatura): with a term the session whose id is DSCD-leg-PL-num, else the first of that term whose id ends in -PL-num;
    without a term (null) the only one whose id ends so. Null where there is none, or more than one without a term.

    Numbers are cut out of the ids, so all joins are on equality.
    """
    s = sessions.select("pleno_id", F.col("legislatura").alias("leg"), F.nullif(F.regexp_extract("pleno_id", r"-PL-(\d+)$", 1), F.lit("")).alias("num")).filter("num is not null").distinct()
    q = asked.withColumn("own", F.concat(F.lit("DSCD-"), F.col("leg").cast("string"), F.lit("-PL-"), F.col("num")))
    q = q.join(s.select(F.col("pleno_id").alias("own"), F.col("pleno_id").alias("named")).distinct(), "own", "left")
    q = q.join(s.groupBy("leg", "num").agg(F.min("pleno_id").alias("of_term")), ["leg", "num"], "left")
    alone = s.select("pleno_id", "num").distinct().groupBy("num").agg(F.count(F.lit(1)).alias("n"), F.min("pleno_id").alias("only"))
    q = q.join(alone, "num", "left")
    found = F.when(F.col("leg").isNull(), F.when(F.col("n") == 1, F.col("only"))).otherwise(F.coalesce("named", "of_term"))
    return q.select(*asked.columns, found.alias("pleno_id"))
