"""Whose party and role: overrides, summaries, the registry and a speaker's own parenthesis, term by term.

All lookups are joins on equality: names one edit apart meet under deletion variants, names cut off at a word meet under
their beginnings. Names are keyed by record.registry_name, or by another function of a column given as key.
Neither names nor rosters have a bound, and Spark takes the variants of a name for one row, so all joins are merge joins by a hint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gazette as gz
from ..functions import record as rec
from .components import written

#: Shorter names are looked up as they are, and without spaces, only.
LEAST = 6


def met(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """Rows of a and b with equal keys, neither of which goes to every task."""
    return a.join(b.hint("merge"), on, how)


def tight(c: str) -> Column:
    return F.replace(F.col(c), F.lit(" "), F.lit(""))


def party_map(texts: DataFrame, key: Callable[[Column], Column] = rec.registry_name) -> DataFrame:
    """(leg, name, sigla, n) from summaries texts(leg, text): of each speaker and term the group most mentioned with the name, ties by its letters.

    Only mentions of a known group count.
    """
    m = texts.select("leg", F.explode(gz.group_mentions(F.col("text"))).alias("m"))
    m = m.select("leg", key(F.col("m.name")).alias("name"), rec.group_letters(F.concat(F.lit("grupo parlamentario "), "m.grupo")).alias("sigla"))
    c = m.filter(F.col("sigla").isin(*rec.KNOWN_GROUPS)).groupBy("leg", "name", "sigla").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("leg", "name").orderBy(F.desc("n"), "sigla"))
    return c.withColumn("k", first).filter("k = 1").drop("k")


def _variants(c: str) -> Column:
    cuts = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1, F.length(c))))
    return F.explode(F.array_distinct(F.concat(cuts, F.array(c)))).alias("v")


def _beginnings(c: str) -> Column:
    """The first one, two, ... words of a name, without the whole."""
    w = F.split(c, " ")
    return F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.when(i < F.size(w), F.array_join(F.slice(w, 1, i), " ")))).alias("b")


def registry_hits(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(leg, name, key) of the registry's key for names(leg, name): itself, without spaces, the only one within an edit, the only one that continues it or that it continues.

    registry is (leg, key). Where no key is one edit away, a beginning at a word's end decides. Several keys alike without spaces: the smallest.
    """
    # each is read several times
    q, r = written(names.select("leg", "name").distinct(), "names"), written(registry.select("leg", "key").distinct(), "registry")
    same = met(q, r.withColumn("name", F.col("key")), ["leg", "name"]).select("leg", "name", "key", F.lit(1).alias("via"))
    t = r.groupBy("leg", tight("key").alias("t")).agg(F.min("key").alias("key"))
    spaced = met(q.withColumn("t", tight("name")), t, ["leg", "t"]).select("leg", "name", "key", F.lit(2).alias("via"))
    long_ = q.filter(F.length("name") >= LEAST)
    near = met(long_.select("leg", "name", _variants("name")), r.filter(F.length("key") > 0).select("leg", "key", _variants("key")), ["leg", "v"]).select("leg", "name", "key").distinct()
    near = near.filter(F.levenshtein("name", "key", 1) >= 0)
    longer = met(long_, r.select("leg", "key", _beginnings("key")).filter("b is not null").withColumnRenamed("b", "name"), ["leg", "name"])
    shorter = met(long_.select("leg", "name", _beginnings("name")).filter("b is not null"), r.withColumn("b", F.col("key")), ["leg", "b"])
    begun = longer.select("leg", "name", "key").union(shorter.select("leg", "name", "key")).distinct()
    fuzzy = near.withColumn("d", F.lit(1)).union(met(begun, near, ["leg", "name", "key"], "left_anti").withColumn("d", F.lit(0)))
    n = fuzzy.groupBy("leg", "name").agg(F.sum("d").alias("near"), F.count(F.lit(1)).alias("all"), F.min(F.when(F.col("d") == 1, F.col("key"))).alias("k1"), F.min(F.when(F.col("d") == 0, F.col("key"))).alias("k0"))
    only = F.when(F.col("near") == 1, F.col("k1")).when((F.col("near") == 0) & (F.col("all") == 1), F.col("k0"))
    fuzzy = n.select("leg", "name", only.alias("key"), F.lit(3).alias("via")).filter("key is not null")
    first = F.row_number().over(Window.partitionBy("leg", "name").orderBy("via"))
    return written(same.union(spaced).union(fuzzy).withColumn("r", first).filter("r = 1").drop("r", "via"), "hits")


def resolve(names: DataFrame, overrides: DataFrame, summaries: DataFrame, registry: DataFrame) -> DataFrame:
    """(leg, name, sigla, canon, via) of every distinct names(leg, name).

    In this order: overrides(leg, name, sigla) of the term, overrides without a term, summaries(leg, name, sigla), those without spaces,
    registry(leg, key, sigla, canon) by registry_hits; else "". canon is the registry's own form, null where it has none. Each table
    has one row for a key.
    """
    q = written(names.select("leg", "name").distinct(), "asked")
    summaries = written(summaries, "summaries")
    hit = met(registry_hits(q, registry), registry.select("leg", "key", F.col("sigla").alias("registered"), "canon"), ["leg", "key"]).drop("key")
    own = overrides.filter("leg is not null").select("leg", "name", F.col("sigla").alias("own"))
    any_ = overrides.filter("leg is null").select("name", F.col("sigla").alias("always"))
    said = summaries.select("leg", "name", F.col("sigla").alias("said"))
    loose = summaries.groupBy("leg", tight("name").alias("t")).agg(F.min_by("sigla", "name").alias("loose"))
    # rows without a term have nothing of a term, only what holds for all
    j = met(met(met(q, hit, ["leg", "name"], "left"), own, ["leg", "name"], "left"), said, ["leg", "name"], "left")
    j = met(met(j, any_, "name", "left").withColumn("t", tight("name")), loose, ["leg", "t"], "left")
    steps = ["own", "always", "said", "loose", "registered"]
    via = F.lit(None).cast("string")
    for s in reversed(steps):
        via = F.when(F.col(s).isNotNull(), s).otherwise(via)
    return j.select("leg", "name", F.coalesce(*steps, F.lit("")).alias("sigla"), "canon", via.alias("via"))


def attach(speeches: DataFrame, overrides: DataFrame, summaries: DataFrame, registry: DataFrame, key: Callable[[Column], Column] = rec.registry_name) -> DataFrame:
    """speeches(leg, speaker, paren, ...) with speaker as it is shown, party and role.

    A regional representative and the ombudsman have no party; of the government's members the name and the office may stand either way round; the chair has no party;
    a deputy's party comes from resolve(), else from an own parenthesis that names a known group. Other columns pass through. Nulls count as "".
    """
    s, paren = F.trim(rec.text_of(F.col("speaker"))), F.trim(rec.text_of(F.col("paren")))
    up = F.upper(s)
    branch = F.when(F.startswith(up, F.lit("REPRESENTANTE")), "representante").when(F.contains(up, F.lit("DEFENSOR DEL PUEBLO")), "defensor")
    branch = branch.when(rec.in_government(s) | rec.in_government(paren), "gobierno").when(rec.has_any(up, rec.CHAIR), "presidencia").otherwise("diputado")
    d = speeches.withColumns({"_s": s, "_p": paren, "_b": branch})
    titled = rec.in_government(F.col("_s"))
    name = F.when(F.col("_b") == "gobierno", F.when(titled, F.col("_p")).otherwise(F.col("_s"))).when(F.col("_b") == "diputado", F.col("_s"))
    d = d.withColumns({"_name": name, "_office": F.when(titled, F.col("_s")).otherwise(F.col("_p")), "_key": F.nullif(key(name), F.lit(""))})
    d = written(d, "speeches")
    known = resolve(d.filter("_key is not null").select("leg", F.col("_key").alias("name")), overrides, summaries, registry)
    known = known.select(F.col("leg").alias("_leg"), F.col("name").alias("_name_of"), "sigla", "canon")
    # a speech without a term still meets what holds for all terms
    d = met(d, known, F.col("leg").eqNullSafe(F.col("_leg")) & (F.col("_key") == F.col("_name_of")), "left").drop("_leg", "_name_of")
    first = rec.is_first_name(F.col("_p"))
    letters = rec.group_letters(F.col("_p"))
    own = F.when((F.col("_p") != "") & ~first & letters.isin(*rec.KNOWN_GROUPS), letters).otherwise("")
    is_ = lambda b: F.col("_b") == b
    apart = F.when(F.col("_p") != "", F.concat("_p", F.lit(" ("), "_s", F.lit(")"))).otherwise(F.col("_s"))
    who = F.coalesce("canon", rec.title_case(F.col("_name")), F.lit(""))
    member = F.when((who != "") & (F.col("_office") != ""), F.concat(who, F.lit(" ("), rec.title_case(F.col("_office")), F.lit(")"))).when(who != "", who).otherwise(F.col("_s"))
    deputy = F.concat(F.coalesce(F.upper("canon"), "_s"), F.when(first, F.concat(F.lit(" ("), "_p", F.lit(")"))).otherwise(""))
    shown = F.when(is_("representante") | is_("defensor"), apart).when(is_("gobierno"), member).when(is_("presidencia"), F.col("_s")).otherwise(deputy)
    sigla = F.coalesce("sigla", F.lit(""))
    party = F.when(is_("gobierno"), sigla).when(is_("diputado"), F.when(sigla != "", sigla).otherwise(own)).otherwise("")
    role = F.when(is_("representante"), "representante autonómico").when(is_("defensor"), "otros").when(is_("gobierno"), rec.office(F.col("_office"))).otherwise(F.col("_b"))
    rest = [c for c in speeches.columns if c not in ("speaker", "paren", "party", "role")]
    return d.select(*rest, shown.alias("speaker"), party.alias("party"), role.alias("role"))
