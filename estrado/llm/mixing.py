"""Mixing sources to target weights: Pareto order sampling.

Every source gets a target in words. A document is expected

    e = min(repeat, level * words ** LENGTH_POWER)

times in the mix, the level of a source being such that the expected words add up to its target:
longer documents are likelier than short ones, by the root of their words. floor(e) copies are certain; what is left,
pi = e - floor(e), is the document's own inclusion probability. Each document draws u from
a hash of its row and gets the Pareto rank

    q = (u / (1 - u)) / (pi / (1 - pi))

and a source takes its documents in the order of q until their words fill what the
certain copies leave of the target; the document left over whose size is nearest to the last
gap closes it. The sample's size is thus fixed, in words.

All of it is DataFrame functions. Levels come from the histogram of sizes. The running sum in the order of q is never one
window over a source: q / (1 + q), which lies in 0..1, falls into bins, sums by (source, bin) find
the bin in which the target is crossed, and only that bin is ordered row by row. The
number of bins follows the number of documents, so a bin holds about ROWS_PER_BIN of
them however large a source is.

Rows that are equal in all columns are one class. Its n members draw n times, so the class takes part in the order as n
documents, and the copies that it wins go to its rows by number; a class of many rows is numbered in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import own_names, words_of, written

SEED = 20240229
ROWS_PER_BIN = 2000
#: Equal rows that are numbered together, about.
PART = 1000
#: Sources up to this many rows are broadcast (a row is a name and some numbers); more are joined by a shuffle. So are classes of equal rows.
BROADCAST_SOURCES = 50_000
LENGTH_POWER = 0.5


def allocate(sources: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """Targets of sources(source, source_size), by weights that repeat in code point order, null last.

    A target is min(repeat * size, level * weight): the level at which all targets add up
    to share * total. Sources are capped in the order of size / weight, so the level is
    found with one running sum over the (small) table of sources. A source of size 0 has target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(repeat))
    t = t.withColumn("turn", F.col("cap") / F.col("weight"))
    order = Window.orderBy("turn", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("total", F.sum("source_size").over(every) * float(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    # the first source, in this order, that its level does not cap sets the level of all after it
    level = F.min(F.when(F.col("level") <= F.col("turn"), F.struct("turn", "level"))).over(every)["level"]
    return t.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select(
        "source", "source_size", "target"
    )


def _joined(left: DataFrame, right: DataFrame, small, how: str = "inner", key: str = "source") -> DataFrame:
    """left with right's columns, by a source that may be null; right has a row for each source."""
    (k,) = own_names(left, "source_of")
    right = right.withColumnRenamed("source", k)
    return left.join(small(right), F.col(f"`{key}`").eqNullSafe(F.col(k)), how).drop(k)


def _levels(sizes: DataFrame, targets: DataFrame, repeat: float, power: float, small) -> DataFrame:
    """(source, level) from sizes(source, size, n): the documents from some size on are expected repeat times, all below by the level.

    The window is over the distinct sizes of a source, never over its documents.
    """
    h = _joined(sizes.filter("size > 0"), targets.select("source", "target"), small)
    w = F.pow(F.col("size").cast("double"), F.lit(power))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    full = F.coalesce(F.sum(F.col("size") * F.col("n") * F.lit(float(repeat))).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    below = F.sum(F.col("size") * F.col("n") * w).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    h = h.withColumn("level", (F.col("target") - full) / below).filter(F.col("level") * w <= F.lit(float(repeat)))
    return h.groupBy("source").agg(F.max_by("level", "size").alias("level"))


def _expected(size: Column, level: Column, repeat: float, power: float) -> Column:
    """Expected copies of a document; without a level all of its source are taken repeat times."""
    e = F.least(F.lit(float(repeat)), F.coalesce(level, F.lit(float("inf"))) * F.pow(size.cast("double"), F.lit(power)))
    return F.when(size > 0, e).otherwise(F.lit(0.0))


def _draw(tie: Column, k: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(tie, k.cast("long")), 11).cast("double") + 0.5) / float(1 << 53)


def _place(u: Column, pi: Column) -> Column:
    """q / (1 + q) of the Pareto rank q: rises with q, between 0 and 1; null where nothing is left to chance."""
    return F.when(pi > 0, u * (1 - pi) / (u * (1 - pi) + (1 - u) * pi))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, repeat: float = 2.0, seed: int = SEED, power: float = LENGTH_POWER) -> DataFrame:
    """docs with size, source_size, target and copies (0, 1 or 2; at most repeat).

    Null text has size 0 and is never taken. Null source is a source of its own. Rows that
    repeat a doc_id are separate documents. Rows equal in all columns (those of map type apart) draw once each: a
    source made of one repeated row comes within one document of its target, as any other. An empty table gives
    an empty table. Other columns pass through under any name; columns named like the new ones are replaced. Reruns agree.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType)) and "map<" not in f.dataType.simpleString()]
    tie = F.xxhash64(F.lit(seed), *plain)
    lean = docs.select("source", words_of(F.col("text")).alias("size"), tie.alias("tie"))
    classes = written(lean.groupBy("source", "size", "tie").agg(F.count(F.lit(1)).alias("n")), "draws")
    sizes = written(classes.groupBy("source", "size").agg(F.sum("n").alias("n")), "sizes")
    sums = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    small = F.broadcast if sums.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else (lambda x: x)

    targets = allocate(sums.select("source", "source_size"), weights, share, repeat)
    plan = _joined(_joined(targets, sums.select("source", "n"), small), _levels(sizes, targets, repeat, power, small), small, "left")
    e = _expected(F.col("size"), F.col("level"), repeat, power)
    whole = F.floor(e + 1e-9)
    left = F.greatest(e - whole, F.lit(0.0))
    pi = F.when(left > 1e-9, left).otherwise(F.lit(0.0))
    certain = _joined(sizes, plan.select("source", "level"), small).groupBy("source").agg(F.sum(whole * F.col("size") * F.col("n")).alias("certain"))
    plan = _joined(plan, certain, small).withColumn("rest", F.greatest(F.col("target") - F.col("certain"), F.lit(0.0)))
    plan = written(plan, "targets")

    # a row for each draw; the rows of a large class are made in many tasks
    open_ = _joined(classes.withColumnRenamed("n", "members"), plan.select("source", "n", "level", "rest"), small).withColumn("pi", pi).filter("pi > 0")
    few = open_.filter(F.col("members") <= PART).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("members") - 1)))
    many = open_.filter(F.col("members") > PART).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("members") - 1, F.lit(PART).cast("long"))))
    many = many.repartition(F.xxhash64("tie", "k")).withColumn("k", F.explode(F.sequence(F.col("k"), F.least(F.col("k") + PART, F.col("members")) - 1)))
    x = _place(_draw(F.col("tie"), F.col("k")), F.col("pi"))
    bin_ = lambda x: F.floor(x * F.ceil(F.col("n") / ROWS_PER_BIN))
    draws = few.unionByName(many).select("source", "size", "tie", "k", "members", "rest", x.alias("x"), bin_(x).alias("bin"))

    bins = draws.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    crossing = bins.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    crossing = written(crossing.select("source", F.col("bin").alias("cut_bin"), "before"), "crossings")
    near = _joined(draws, crossing, small).filter(F.col("bin") == F.col("cut_bin"))
    in_order = Window.partitionBy("source").orderBy("x", "tie", "k").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("before") + F.sum("size").over(in_order)).filter(F.col("upto") <= F.col("rest"))
    last = near.groupBy("source").agg(F.max(F.struct("x", "tie", "k")).alias("last"), F.max("upto").alias("upto"))
    cut = _joined(_joined(plan.select("source", "rest"), crossing, small), last, small, "left")
    cut = written(cut.select("source", "cut_bin", "last", (F.col("rest") - F.coalesce("upto", "before")).alias("gap")), "cuts")

    def ahead(x: Column, tie: Column, k: Column) -> Column:
        """Whether a draw is among those that fill the target; a source that never crosses it takes all."""
        own = F.struct(x.alias("x"), tie.alias("tie"), k.cast("long").alias("k"))
        return F.col("cut_bin").isNull() | (bin_(x) < F.col("cut_bin")) | ((bin_(x) == F.col("cut_bin")) & F.coalesce(own <= F.col("last"), F.lit(False)))

    # of the draws left, the one whose size is nearest to the gap closes it, if that brings the source nearer
    drawn = _joined(_joined(draws, plan.select("source", "n"), small), cut, small, "left")
    taken = ahead(F.col("x"), F.col("tie"), F.col("k"))
    off = F.abs(F.col("size") - F.col("gap"))
    closing = drawn.filter(~taken & (off < F.col("gap"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "x", "tie", "k")).alias("c"))
    marks = _joined(_joined(plan.drop("rest", "certain"), cut.drop("gap"), small, "left"), closing.select("source", F.struct("c.tie", "c.k").alias("closing")), small, "left")
    marks = written(marks, "marks")

    # copies by class, for the classes with more than one row
    equal = classes.filter("n > 1").groupBy("tie").agg(F.sum("n").alias("members"))
    repeats = equal.limit(BROADCAST_SOURCES + 1).count()
    closes = (F.col("tie") == F.col("closing.tie")) & (F.col("k") == F.col("closing.k"))
    won = _joined(drawn, marks.select("source", "closing"), small, "left").filter("members > 1").filter(taken | F.coalesce(closes, F.lit(False)))
    won = won.groupBy("tie").agg(F.count(F.lit(1)).alias("won"))

    # columns of the operator's own have names that no column of docs has
    o_tie, o_u, o_part, o_own, o_n, o_base, o_won, *m = own_names(docs, "tie", "u", "part", "own", "members", "base", "won", *[f"mark_{c}" for c in marks.columns])
    named = dict(zip(marks.columns, m))
    out = docs.withColumn(o_tie, tie).withColumn("size", words_of(F.col("text")))
    single = out
    if repeats:
        by_tie = equal.select(F.col("tie").alias(o_tie), F.col("members").alias(o_n))
        single = out.join(by_tie if repeats > BROADCAST_SOURCES else F.broadcast(by_tie), o_tie, "left")
        part = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col(o_n) / PART))
        same = written(single.filter(F.col(o_n).isNotNull()).withColumn(o_part, part), "equal_documents")
        single = single.filter(F.col(o_n).isNull()).drop(o_n)
    # a source that may be null: the row's own, renamed, is joined to
    cols = [F.col(c).alias(n) for c, n in named.items()]

    def marked(rows: DataFrame) -> DataFrame:
        right = marks.select(*cols)
        return rows.join(small(right), F.col("`source`").eqNullSafe(F.col(named["source"])))

    def result(rows: DataFrame, extra: Column) -> DataFrame:
        e = _expected(F.col("size"), F.col(named["level"]), repeat, power)
        copies = F.least(F.floor(e + 1e-9) + extra, F.lit(int(repeat))).cast("int")
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "size", F.col(named["source_size"]).alias("source_size"), F.col(named["target"]).alias("target"), copies.alias("copies"))

    e_row = _expected(F.col("size"), F.col(named["level"]), repeat, power)
    left_row = e_row - F.floor(e_row + 1e-9)
    x_row = _place(_draw(F.col(o_tie), F.lit(0)), F.when(left_row > 1e-9, left_row).otherwise(F.lit(0.0)))
    bin_row = F.floor(x_row * F.ceil(F.col(named["n"]) / ROWS_PER_BIN))
    own = F.struct(x_row.alias("x"), F.col(o_tie).alias("tie"), F.lit(0).cast("long").alias("k"))
    in_ = F.col(named["cut_bin"]).isNull() | (bin_row < F.col(named["cut_bin"])) | ((bin_row == F.col(named["cut_bin"])) & F.coalesce(own <= F.col(named["last"]), F.lit(False)))
    in_ = in_ | F.coalesce(F.col(named["closing"])["tie"] == F.col(o_tie), F.lit(False))
    rows = result(marked(single), F.when(x_row.isNotNull() & in_, 1).otherwise(0))
    if not repeats:
        return rows
    counts = same.groupBy(o_tie, o_part).agg(F.count(F.lit(1)).alias(o_base))
    upto = Window.partitionBy(o_tie).orderBy(o_part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(o_base, F.coalesce(F.sum(o_base).over(upto), F.lit(0)))
    number = F.row_number().over(Window.partitionBy(o_tie, o_part).orderBy(o_tie)) - 1
    same = same.withColumn(o_own, number).join(counts, [o_tie, o_part])
    wins = won.select(F.col("tie").alias(o_tie), F.col("won").alias(o_won))
    same = same.join(wins if repeats > BROADCAST_SOURCES else F.broadcast(wins), o_tie, "left")
    win = (F.col(o_own) + F.col(o_base)) < F.coalesce(F.col(o_won), F.lit(0))
    return rows.unionByName(result(marked(same), win.cast("int")))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of docs."""
    (copy,) = own_names(docs, "copy")
    mixed = mix(docs, **how)
    times = F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias(copy)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], times).drop(copy)


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table, with_defaults

    docs = with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    m = mix(docs)
    return m.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
