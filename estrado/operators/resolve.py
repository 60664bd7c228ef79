"""Resolving names: token hits, cascades of lookups, edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_token_hits(queries: DataFrame, speakers: DataFrame, least_length: int = 3) -> DataFrame:
    """(qid, key, hits, n) of every speaker(key, n) in whose key a word of queries(qid, q) occurs; ordered by hits, then n.

    Words meet whole words and their beginnings by trigram: each speaker key is indexed under its distinct trigrams and each word is looked up
    under its first one, so the join is on equality; containment is then verified.
    """
    words = queries.select("qid", F.explode(F.array_distinct(F.split("q", " "))).alias("w")).filter(F.length("w") >= least_length)
    w = words.withColumn("g", F.left("w", F.lit(3)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - 2, F.lit(1))), lambda i: F.substr(F.col("key"), i, F.lit(3))))
    s = speakers.select("key", "n", F.explode(grams).alias("g"))
    hit = w.join(s, "g").filter(F.contains("key", F.col("w")))
    return hit.groupBy("qid", "key").agg(F.countDistinct("w").alias("hits"), F.first("n").alias("n"))


def unique_near(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, canon) of names(name) with exactly one registry(canon) within one edit.

    Candidates share a deletion variant: a name with one character left out, or the name itself. Two names within one edit always share
    one, so the join is on equality and each name has length + 1 keys.
    """

    def keyed(df: DataFrame, c: str) -> DataFrame:
        cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1, F.length(c))))
        return df.select(c, F.explode(F.array_distinct(F.concat(cuts, F.array(c)))).alias("k"))

    near = keyed(names.select("name").distinct(), "name").join(keyed(registry.select("canon").distinct(), "canon"), "k")
    near = near.filter(F.levenshtein("name", "canon", 1) >= 0).select("name", "canon").distinct()
    return near.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("canon")).filter("n = 1").drop("n")


def cascade(names: DataFrame, registry: DataFrame, prefix: int = 6) -> DataFrame:
    """(name, canon, via): by the name itself, without spaces, by a unique one within one edit, by a unique one that it begins; else null."""
    q = names.select("name").distinct()
    reg = registry.select("canon").distinct()
    exact = q.join(reg.withColumn("name", F.col("canon")), "name").select("name", "canon", F.lit(1).alias("via"))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    tight = q.withColumn("b", bare(F.col("name"))).join(reg.groupBy(bare(F.col("canon")).alias("b")).agg(F.min("canon").alias("canon")), "b").select("name", "canon", F.lit(2).alias("via"))
    near = unique_near(q, reg).select("name", "canon", F.lit(3).alias("via"))
    starts = q.filter(F.length("name") >= prefix).withColumn("p", F.left("name", F.lit(prefix))).join(reg.withColumn("p", F.left("canon", F.lit(prefix))), "p").filter(F.startswith("canon", F.col("name")))
    starts = starts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("canon")).filter("n = 1").select("name", "canon", F.lit(4).alias("via"))
    first = F.row_number().over(Window.partitionBy("name").orderBy("via"))
    hit = exact.union(tight).union(near).union(starts).withColumn("k", first).filter("k = 1").drop("k")
    return q.join(hit, "name", "left")


def holding(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """queries(q) with each labels(label, ...) that holds it, whatever the capitals. Labels are indexed under their pieces of one to three letters, a text is looked up under its first, so the join is on equality. An empty text holds nowhere."""
    l = labels.withColumn("_k", F.lower("label"))
    piece = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_k") - size + 1, F.lit(1))), lambda i: F.substr(F.col("_k"), i, F.lit(size)))
    l = l.withColumn("_g", F.explode(F.array_distinct(F.concat(*[piece(i) for i in (1, 2, 3)]))))
    q = queries.filter("q <> ''").withColumn("_q", F.lower("q")).withColumn("_g", F.left("_q", F.least(F.length("_q"), F.lit(3))))
    return q.join(l, "_g").filter(F.contains("_k", F.col("_q"))).drop("_g", "_k", "_q")


def party(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, label) of queries(qid, q): the label that is q's canonical form, else the best of labels(label, n), else the canonical form.

    A label that holds the whole text scores 100, another one for each word of three letters or more that it holds; of equal scores the larger n
    wins, then the label. Labels are indexed under their pieces of one to three letters, of which a text or word is looked up under its first, so the join is on equality.
    """
    from ..functions.text import canonical_party, norm_key

    l = labels.select("label", "n", norm_key(F.col("label")).alias("lk"))
    piece = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("lk") - size + 1, F.lit(1))), lambda i: F.substr(F.col("lk"), i, F.lit(size)))
    index = l.select("label", "n", "lk", F.explode(F.array_distinct(F.concat(*[piece(i) for i in (1, 2, 3)]))).alias("g"))
    q = queries.select("q").distinct().withColumn("key", norm_key(F.col("q"))).filter("key <> ''")
    queries = queries.withColumn("canon", canonical_party(F.col("q")))
    words = q.select("q", F.col("key").alias("w"), F.lit(100).alias("score")).union(q.select("q", F.explode(F.filter(F.split("key", " "), lambda t: F.length(t) >= 3)), F.lit(1)))
    hit = words.withColumn("g", F.left("w", F.least(F.length("w"), F.lit(3)))).join(index, "g").filter(F.contains("lk", F.col("w")))
    score = F.when(F.max("score") == 100, 100).otherwise(F.sum("score"))
    best = hit.groupBy("q", "label").agg(score.alias("score"), F.first("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("n"), "label"))
    best = best.withColumn("k", first).filter("k = 1").select("q", F.col("label").alias("best"))
    same = labels.select(F.col("label").alias("canon"), F.col("label").alias("same")).filter("canon <> ''")
    return queries.join(best, "q", "left").join(same, "canon", "left").select("qid", F.coalesce("same", "best", "canon").alias("label"))
