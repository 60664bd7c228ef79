"""Handovers as a state machine over event time.

Segments may come in any order and in any cut into batches. A session's rows wait in its state until the watermark has passed them; then they are folded in the order of their time by the
rules of operators.sequences.Handover, and each is written once with its turn. One timer stands for the earliest row that waits. A session that has been silent for longer than idle is
over, and what follows starts anew: so its state can be dropped by a timer of its own, and no outcome hangs on when that happens.
"""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.components import scratch
from ..operators.sequences import Handover

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns(StatefulProcessor):
    """Rows (at, seg_id, call, valid) of a session, at in microseconds; gives (pleno_id, seg_id, turno). Rows without a seg_id only move the time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seg_id long, call boolean, valid boolean")
        self.fold = handle.getValueState("fold", "turns int, tail boolean, last long")

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for p in rows:
            p = p[p.seg_id.notna()]
            if len(p):
                self.waiting.appendList(list(zip(p["at"].astype("int64").tolist(), p.seg_id.astype("int64").tolist(), p["call"].astype(bool).tolist(), p["valid"].astype(bool).tolist())))
                low = int(p["at"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] <= now * 1000]
        left = waiting[len(ready) :]
        fold, last = Handover(), None
        if self.fold.exists():
            fold.turns, fold.tail, last = self.fold.get()
        out = []
        for at, seg_id, call, valid in ready:
            if last is not None and at - last > self.idle_ms * 1000:
                fold = Handover()
            out.append((key[0], seg_id, fold.label(call, valid)))
            last = at
        if ready:
            self.fold.update((fold.turns, fold.tail, last))
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if left:
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        elif last is not None:
            over = last // 1000 + self.idle_ms
            if now > over:
                self.fold.clear()
            else:
                self.handle.registerTimer(over + 1)
        if out:
            yield pd.DataFrame(out, columns=["pleno_id", "seg_id", "turno"])

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """State with timers needs this store; the session's own setting comes back."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, own)


def labelled(segments: DataFrame, late: str, idle: str = "7 days") -> DataFrame:
    """A stream (pleno_id, seg_id, turno) of a stream segments(pleno_id, seg_id, t timestamp, call, valid). Rows later than late behind the newest are dropped, as Spark drops them."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    s = segments.withWatermark("t", late).select("pleno_id", "t", F.unix_micros("t").alias("at"), "seg_id", F.coalesce("call", F.lit(False)).alias("call"), F.coalesce("valid", F.lit(False)).alias("valid"))
    return s.groupBy("pleno_id").transformWithStateInPandas(Turns(idle_ms), outputStructType="pleno_id long, seg_id long, turno int", outputMode="Append", timeMode="EventTime")


def over_files(spark: SparkSession, folder: str, calls: tuple[str, ...] = ("signup", "purchase"), valid=None, late: str = "1 hour", idle: str = "7 days", per_pass: int = 1) -> DataFrame:
    """(pleno_id, seg_id, turno) of the events in a folder, per_pass files in each batch; valid is a condition on events, all calls are without it.

    After the last file, marks of a much later time from a second source let the watermark pass the last rows.
    """
    from .watcher import files, run_once

    out, check, marks = scratch(spark, "handovers"), scratch(spark, "handovers-state"), scratch(spark, "handovers-marks")
    kind = "pleno_id long, seg_id long, t timestamp, call boolean, valid boolean"
    spark.createDataFrame([], kind).write.parquet(marks)

    def stream() -> DataFrame:
        e = files(spark, folder, "events", per_pass)
        e = e.select(F.col("user_id").cast("long").alias("pleno_id"), F.col("event_id").cast("long").alias("seg_id"), F.col("ts").cast("timestamp").alias("t"), F.col("event_type").isin(*calls).alias("call"), F.expr(valid or "true").alias("valid"))
        return labelled(e.unionByName(spark.readStream.schema(kind).parquet(marks)), late, idle)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with rocksdb(spark):
        run_once(stream(), each, check)
        last = spark.read.parquet(f"{folder}/events.parquet*").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).filter("t is not null")
        for days in (1, 2):
            at = F.col("t") + F.expr(f"INTERVAL {late}") + F.expr(f"INTERVAL {days} DAYS")
            last.select(F.lit(None).cast("long").alias("pleno_id"), F.lit(None).cast("long").alias("seg_id"), at.alias("t"), F.lit(False).alias("call"), F.lit(False).alias("valid")).write.mode("append").parquet(marks)
            run_once(stream(), each, check)
    return spark.read.schema("pleno_id long, seg_id long, turno int, batch int").parquet(out).drop("batch")
