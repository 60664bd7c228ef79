"""The given tables, and the shapes of the record that queries read them as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions: lineitem is the speech, orders its session."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("pleno_id"),
        F.col("l_linenumber").alias("idx"),
        F.concat(F.lit("sp"), F.col("l_suppkey")).alias("speaker"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("party"),
        F.when(F.col("l_linestatus") == "O", "presidencia").otherwise("diputado").alias("role"),
        F.col("o_orderpriority").alias("topic"),
        F.year("o_orderdate").alias("legislatura"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha_iso"),
        F.col("l_quantity").cast("long").alias("n_words"),
        (F.col("l_extendedprice") > 0).alias("has_text"),
    )


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interventions by their own columns alone, where nothing of the session is asked for."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pleno_id"),
        F.concat(F.lit("sp"), F.col("l_suppkey")).alias("speaker"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("party"),
        F.when(F.col("l_linestatus") == "O", "presidencia").otherwise("diputado").alias("role"),
        F.col("l_quantity").cast("long").alias("n_words"),
    )


IV = """iv AS (
  SELECT l_orderkey AS pleno_id, l_linenumber AS idx, 'sp' || l_suppkey AS speaker,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS party,
         CASE WHEN l_linestatus = 'O' THEN 'presidencia' ELSE 'diputado' END AS role, o_orderpriority AS topic,
         CAST(year(o_orderdate) AS INTEGER) AS legislatura, strftime(o_orderdate, '%Y-%m-%d') AS fecha_iso,
         CAST(l_quantity AS BIGINT) AS n_words, l_extendedprice > 0 AS has_text
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments of sessions, from events: a user is a session, an event type a speaker, value the minutes it lasts."""
    start = F.col("ts").cast("timestamp").cast("long").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pleno_id"),
        F.col("event_id").alias("seg_id"),
        start.alias("start"),
        (start + F.round(F.col("value") * 60)).alias("end"),
        F.col("event_type").alias("speaker"),
        F.col("event_id").cast("string").alias("text"),
    )


SEG = """seg AS (
  SELECT user_id AS pleno_id, event_id AS seg_id, CAST(floor(epoch(ts)) AS DOUBLE) AS start, CAST(floor(epoch(ts)) AS DOUBLE) + round(value * 60) AS "end",
         event_type AS speaker, CAST(event_id AS VARCHAR) AS text
  FROM events
)"""
