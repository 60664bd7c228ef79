"""Streams over the given events, and the SQL of what they end with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import handover, watcher

#: Turns of all segments; a run of valid calls hands over at every other one.
LABELS = """WITH c AS (SELECT user_id pleno_id, event_id seg_id, event_type IN ('signup', 'purchase') call, {0} named, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events), i AS (SELECT *, n - row_number() OVER (PARTITION BY pleno_id, call AND named ORDER BY n) isla FROM c),
h AS (SELECT *, call AND named AND row_number() OVER (PARTITION BY pleno_id, call AND named, isla ORDER BY n) % 2 = 1 releva FROM i), t AS (SELECT *, releva OR (call AND coalesce(lag(releva) OVER (PARTITION BY pleno_id ORDER BY n), false)) mesa, count(*) FILTER (releva) OVER (PARTITION BY pleno_id ORDER BY n) relevos FROM h),
l AS (SELECT pleno_id, seg_id, CASE WHEN mesa THEN -1 ELSE CAST(relevos - 1 AS INTEGER) END turno FROM t)"""
QUERIES = {
    "watcher_available_now": lambda spark, sf: watcher.watch(spark, sf),
    "stream_sessions": lambda spark, sf: watcher.sessions(spark, sf),
    "handover_state": lambda spark, sf: handover.over_files(spark, sf, idle="3650 days").groupBy("pleno_id").agg((F.max("turno") + 1).alias("reached"), F.count_if(F.col("turno") >= 0).alias("dentro")),
    "handover_stream": lambda spark, sf: handover.over_files(spark, sf, valid="value > 20", idle="3650 days"),
}
ORACLE = {
    "watcher_available_now": "SELECT DISTINCT user_id pleno_id, strftime(ts, '%Y-%m-%d') dia FROM events WHERE event_type = 'purchase'",
    "handover_state": LABELS.format("true") + " SELECT pleno_id, max(turno) + 1 reached, count(*) FILTER (turno >= 0) dentro FROM l GROUP BY 1",
    "handover_stream": LABELS.format("value > 20") + " SELECT * FROM l",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) n FROM s GROUP BY user_id, k""",
}
