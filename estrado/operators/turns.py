"""Turns of speech and times: islands, carried values, overlaps, as-of joins.

Functions take segments (pleno_id, seg_id, start, end, speaker, text). A window never leaves its session, so the
largest session bounds a task; nothing is ordered over all sessions at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import record as rec


def session():
    """A session's rows in order."""
    return Window.partitionBy("pleno_id").orderBy("start", "seg_id")


def upto():
    return session().rowsBetween(Window.unboundedPreceding, 0)


def islands(seg: DataFrame, *labels: str) -> DataFrame:
    """seg with turno: the number, from 0, of the run of equal labels that a row stands in."""
    changed = F.lit(False)
    for c in labels or ("speaker",):
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(session()))
    first = F.row_number().over(session()) == 1
    return seg.withColumn("_new", (changed & ~first).cast("int")).withColumn("turno", F.sum("_new").over(upto())).drop("_new")


def turns(seg: DataFrame, *labels: str) -> DataFrame:
    """One row for each run of equal labels: its span, segments and text in order."""
    keys = labels or ("speaker",)
    in_order = F.sort_array(F.collect_list(F.struct("start", "seg_id", "text")))
    g = islands(seg, *keys).groupBy("pleno_id", "turno").agg(
        *[F.first(c).alias(c) for c in keys], F.min("start").alias("start"), F.max_by("end", F.struct("start", "seg_id")).alias("end"), F.count(F.lit(1)).alias("n"), in_order.alias("t")
    )
    return g.withColumn("text", F.array_join(F.transform("t", lambda x: x["text"]), " ")).drop("t")


def carried(seg: DataFrame, value: Column, name: str) -> DataFrame:
    """seg with the last non-null value up to each row; "" before the first."""
    return seg.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(upto()), F.lit("")))


def as_of(seg: DataFrame, points: DataFrame) -> DataFrame:
    """seg with punto: the number of the last of points(pleno_id, punto, at) with at <= start, else 0; of equal times the later point.

    One union and one window, so a session's points and segments are sorted once and no pair of them is made.
    """
    p = points.filter("at is not null").select("pleno_id", F.col("at").alias("_t"), F.lit(0).alias("_k"), F.col("punto").alias("_p"))
    s = seg.withColumn("_t", F.col("start")).withColumn("_k", F.lit(1)).withColumn("_p", F.lit(None).cast("int"))
    w = Window.partitionBy("pleno_id").orderBy("_t", "_k", "_p").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(p, allowMissingColumns=True)
    return both.withColumn("punto", F.coalesce(F.last("_p", ignorenulls=True).over(w), F.lit(0))).filter("_k = 1").drop("_t", "_k", "_p")


def overlap_assign(seg: DataFrame, turns_: DataFrame, bucket: float = 3600.0) -> DataFrame:
    """seg with speaker, solape_s and overlap: who speaks longest within each segment, by overlap with turns(pleno_id, start, end, speaker).

    Ties go to the turn that starts first. overlap is set if the second speaker has 0.6 s or more and 30 % of the segment. Segments that no turn
    meets keep null. Both sides are cut into time buckets, so the join is on equality (session, bucket) and a
    long session is many groups; an overlap is counted in the bucket in which it begins.
    """
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(a), F.col(b)) / bucket)))
    s = seg.select("pleno_id", "seg_id", F.col("start").alias("s0"), F.col("end").alias("s1"), cut("start", "end").alias("b"))
    t = turns_.select("pleno_id", F.col("start").alias("t0"), F.col("end").alias("t1"), "speaker", cut("start", "end").alias("b"))
    hit = s.join(t, ["pleno_id", "b"]).filter((F.col("s0") < F.col("t1")) & (F.col("t0") < F.col("s1")))
    hit = hit.filter(F.floor(F.greatest("s0", "t0") / bucket) == F.col("b"))
    each = hit.groupBy("pleno_id", "seg_id", "speaker").agg(F.sum(F.least("s1", "t1") - F.greatest("s0", "t0")).alias("o"), F.min("t0").alias("first"), F.first(F.col("s1") - F.col("s0")).alias("d"))
    best = F.row_number().over(Window.partitionBy("pleno_id", "seg_id").orderBy(F.desc("o"), "first", "speaker"))
    top = each.withColumn("k", best).filter("k <= 2").groupBy("pleno_id", "seg_id").agg(
        F.max(F.when(F.col("k") == 1, F.col("speaker"))).alias("who"), F.max("o").alias("solape_s"), F.max(F.when((F.col("k") == 2) & (F.col("o") >= 0.6) & (F.col("o") >= 0.3 * F.col("d")), True)).alias("two")
    )
    out = seg.drop("speaker", "overlap").join(top, ["pleno_id", "seg_id"], "left")
    return out.withColumn("speaker", F.col("who")).withColumn("overlap", F.coalesce("two", F.lit(False))).drop("who", "two")


def gap_clusters(x: DataFrame, by: str, value: str, gap: float) -> DataFrame:
    """x with the number of the cluster: a distance over gap to the value before starts a new one."""
    w = Window.partitionBy(by).orderBy(value)
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    return x.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def talk_time(seg: DataFrame, by: str) -> DataFrame:
    """Seconds of each value of by in its session and its share; a session without seconds counts as one."""
    s = seg.groupBy("pleno_id", by).agg(F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("segundos"))
    total = F.sum("segundos").over(Window.partitionBy("pleno_id"))
    return s.withColumn("cuota", F.round(F.col("segundos") / F.when(total > 0, total).otherwise(1.0), 6))


def mode_of(x: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each group, of equals the one seen first."""
    n = x.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))
    return n.withColumn("k", rank).filter("k = 1").select(*by, value, "n")


def followed(rows: DataFrame, session_: str, order: str, text: str, n: int) -> DataFrame:
    """rows with after: the texts of the next n rows of the session, joined by spaces; missing ones are empty."""
    w = Window.partitionBy(session_).orderBy(order)
    return rows.withColumn("after", F.concat_ws(" ", *[F.coalesce(F.lead(text, i).over(w), F.lit("")) for i in range(1, n + 1)]))


def blind_agenda(rows: DataFrame, session_: str, order: str, text: str, most: int = 800) -> DataFrame:
    """(session, agenda) of the chair's rows: sentences that describe a point, in order, one for each beginning of 50 characters, most characters in all.

    Only sentences that begin before the limit are gathered, so a session's list is as short as its agenda.
    """
    s = rows.select(session_, order, rec.agenda_sentences(F.col(text)).alias("s"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(i.alias("i"), F.element_at("s", i).alias("s"), F.try_element_at("s", i + 1).alias("after")))
    s = s.select(session_, order, F.explode(pairs).alias("p")).filter(rec.names_a_point(F.col("p.s"), F.col("p.after")))
    s = s.select(session_, order, F.col("p.i").alias("i"), rec.squeeze(F.col("p.s")).alias("s"), F.left(rec.simple(F.col("p.s")), F.lit(50)).alias("key"))
    s = s.withColumn("k", F.row_number().over(Window.partitionBy(session_, "key").orderBy(order, "i"))).filter("k = 1")
    before = F.coalesce(F.sum(F.length("s") + 1).over(Window.partitionBy(session_).orderBy(order, "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("at", before).filter(F.col("at") < most)
    g = s.groupBy(session_).agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("l"))
    return g.select(session_, F.left(F.array_join(F.transform("l", lambda x: x["s"]), " "), F.lit(most)).alias("agenda"))


def called_points(seg: DataFrame, gap: float = 2.0) -> DataFrame:
    """(pleno_id, seg_id, start, title) of the segments that call a point of the agenda, without those less than gap after the last one kept.

    The title comes from what follows the call and from the two next segments. Calls of a session are some tens, which one fold passes over.
    """
    s = followed(seg.select("pleno_id", "seg_id", "start", rec.text_of(F.col("text")).alias("text")).withColumn("o", F.struct("start", "seg_id")), "pleno_id", "o", "text", 2)
    s = s.filter(F.rlike("text", F.lit(rec.POINT)))
    tail = F.regexp_replace("text", r"(?s)^.*?" + rec.POINT, "")
    title = rec.point_title(F.concat(tail, F.lit(" "), "after"))
    g = s.groupBy("pleno_id").agg(F.sort_array(F.collect_list(F.struct("start", "seg_id", title.alias("title")))).alias("calls"))
    empty = F.array().cast(g.schema["calls"].dataType)
    kept = F.aggregate("calls", empty, lambda a, x: F.when((F.size(a) > 0) & (x["start"] - F.element_at(a, -1)["start"] < gap), a).otherwise(F.concat(a, F.array(x))))
    return g.select("pleno_id", F.explode(kept).alias("c")).select("pleno_id", "c.seg_id", "c.start", "c.title")


def seat_votes(hands: DataFrame, phases: list[str], rel: float, frac: float, least: int) -> DataFrame:
    """(asiento, voto, frac) of hands(asiento, fase, rel): the phase in whose frames the hand is up most, if often enough; of equal ones the earlier, else none."""
    p = hands.groupBy("asiento", "fase").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rel") >= rel).cast("double")).alias("frac"))
    good = (F.col("n") >= least) & (F.col("frac") >= frac)
    order = F.array_position(F.array(*[F.lit(x) for x in phases]), F.col("fase"))
    first = F.row_number().over(Window.partitionBy("asiento").orderBy(F.when(good, F.col("frac")).otherwise(0.0).desc(), order))
    return p.withColumn("k", first).filter("k = 1").select("asiento", F.when(good, F.col("fase")).alias("voto"), "frac")


def vote_phases(words: DataFrame, region: str) -> DataFrame:
    """(region, favor, contra, abstencion, fin) of words(region, word, start): when each phase of a vote begins, and its end.

    For is the first word with 'favor', against the first with 'contra' from there on, and later than it, or there is no vote. Abstentions are called by 'absten',
    or begin as long after against as against did after for; 'aprob' or 'aprueb' after that is the end, or the same length again, 1.5 at least.
    """
    whole = Window.partitionBy(region)
    said = lambda key, after: F.min(F.when(F.contains("word", F.lit(key)) & (F.col("start") >= after), F.col("start"))).over(whole)
    s = words.withColumn("favor", F.min(F.when(F.contains("word", F.lit("favor")), F.col("start"))).over(whole))
    s = s.withColumn("contra", said("contra", F.col("favor"))).filter("contra > favor")
    length = F.col("contra") - F.col("favor")
    s = s.withColumn("x", said("absten", F.col("contra"))).withColumn("abst", F.when(F.col("x") > F.col("contra"), F.col("x")).otherwise(F.col("contra") + length))
    end = F.min(F.when((F.contains("word", F.lit("aprob")) | F.contains("word", F.lit("aprueb"))) & (F.col("start") > F.col("abst")), F.col("start")))
    g = s.groupBy(region).agg(*[F.first(c).alias(c) for c in ("favor", "contra", "abst")], end.alias("y"))
    last = F.coalesce("y", F.col("abst") + F.greatest(F.lit(1.5), length))
    return g.select(region, F.round("favor", 1).alias("favor"), F.round("contra", 1).alias("contra"), F.round("abst", 1).alias("abstencion"), F.round(last, 1).alias("fin"))


def frame_profile(hands: DataFrame, rel: float) -> DataFrame:
    """(fase, t, n, manos, pico) of hands(fase, t, rel): raised and all hands of each frame, pico for the first frame with most raised ones."""
    p = hands.groupBy("fase", "t").agg(F.count_if(F.col("rel") >= rel).alias("n"), F.count(F.lit(1)).alias("manos"))
    best = p.groupBy("fase").agg(F.max(F.struct("n", (-F.unix_micros(F.col("t").cast("timestamp"))).alias("t"))).alias("b"))
    return p.join(best, "fase").withColumn("pico", (F.col("n") == F.col("b.n")) & (-F.unix_micros(F.col("t").cast("timestamp")) == F.col("b.t"))).drop("b")
