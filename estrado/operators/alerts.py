"""Subscriptions against what was detected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVERYTHING = "todos los plenos"
#: Subscribers of everything that travel in one row.
SUBSCRIBERS = 10_000


def matches(subs: DataFrame, found: DataFrame, per_topic: int = 3) -> DataFrame:
    """(pleno_id, email, tema, chunk, token) to send: subs(email, tema, token, pos), found(pleno_id, tema, chunk, sim).

    A subscriber of a topic gets its best per_topic chunks, one of everything the best chunk of each topic. A subscriber's token is
    that of the first row. The detections are joined by topic; those for everything are as many as they are to be sent.
    """
    token = subs.groupBy("email").agg(F.min_by("token", "pos").alias("token"))
    rank = F.row_number().over(Window.partitionBy("pleno_id", "tema").orderBy(F.desc("sim"), "chunk"))
    best = found.withColumn("k", rank).filter(F.col("k") <= per_topic)
    wild = subs.filter(F.col("tema") == EVERYTHING).select("email").distinct()
    named = subs.filter(F.col("tema") != EVERYTHING).select("email", "tema").distinct().join(wild, "email", "left_anti")
    one = named.join(best, "tema").select("pleno_id", "email", "tema", "chunk")
    # everyone who asked for everything gets every first chunk: subscribers in parts of SUBSCRIBERS, each of which the detections meet once
    first = best.filter("k = 1 and tema is not null").select("pleno_id", "tema", "chunk")
    parts = max(1, -(-wild.count() // SUBSCRIBERS))
    groups = wild.groupBy(F.pmod(F.xxhash64("email"), F.lit(parts)).alias("part")).agg(F.collect_list("email").alias("emails"))
    told = first.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(groups, "part")
    each = told.select("pleno_id", F.explode("emails").alias("email"), "tema", "chunk")
    return one.union(each).join(token, "email")
