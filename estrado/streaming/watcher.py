"""Streams: new files only, each notification once, sessions by event time. Handovers with state are in handover.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import scratch
from ..operators.upserts import not_yet

#: Days of a batch up to which only those are read from the outbox.
DAYS = 1000


def files(spark: SparkSession, folder: str, table: str, per_pass: int = 1) -> DataFrame:
    """The files of a table as a stream, per_pass of them in each pass. The schema is read from the files once."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_pass).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}.parquet*")


def run_once(stream: DataFrame, each, checkpoint: str) -> None:
    """All that has come, batch by batch, then an end; what a checkpoint has seen is never seen again."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def notify_once(found: DataFrame, outbox: str, key: list[str], day: str) -> None:
    """Appends to outbox what it lacks by key; a batch that runs again adds nothing.

    The outbox is laid out by day, a column of the key, and only the days that the batch holds are read again.
    """
    spark = found.sparkSession
    new = found.dropDuplicates(key)
    found.limit(0).write.mode("ignore").partitionBy(day).parquet(outbox)
    days = [r[0] for r in new.select(day).distinct().limit(DAYS + 1).collect()]
    done = spark.read.schema(found.schema).parquet(outbox)
    if len(days) <= DAYS:
        done = done.filter(F.col(day).isin(*days))
    not_yet(new, done, key).select(*found.columns).write.mode("append").partitionBy(day).parquet(outbox)


def watch(spark: SparkSession, folder: str, topic: str = "purchase") -> DataFrame:
    """(pleno_id, dia): one notification for each session and day on which topic came up, whatever the number of passes."""
    outbox, mark = scratch(spark, "outbox"), scratch(spark, "watcher")

    def each(batch: DataFrame, _: int) -> None:
        hits = batch.filter(F.col("event_type") == topic).select(F.col("user_id").alias("pleno_id"), F.date_format("ts", "yyyy-MM-dd").alias("dia")).distinct()
        notify_once(hits, outbox, ["pleno_id", "dia"], "dia")

    for _ in range(2):  # the second pass sees no new file
        run_once(files(spark, folder, "events"), each, mark)
    return spark.read.schema("pleno_id long, dia string").parquet(outbox)


def sessions(spark: SparkSession, folder: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): sessions of activity by event time, in append mode: a session is written once, when the watermark has passed its end, and its state is dropped.

    After the last event a mark of a much later time is sent through a second source, so that the watermark passes the last sessions as well. Every batch
    writes a folder of its own, which a batch that runs again replaces.
    """
    out, check, marks = scratch(spark, "sessions"), scratch(spark, "sessions-state"), scratch(spark, "sessions-marks")
    kind = "user_id long, t timestamp"
    spark.createDataFrame([], kind).write.parquet(marks)

    def all_sessions() -> DataFrame:
        e = files(spark, folder, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("t"))
        m = spark.readStream.schema(kind).parquet(marks)
        s = e.unionByName(m).withWatermark("t", late).groupBy("user_id", F.session_window("t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_once(all_sessions(), each, check)
    last = spark.read.parquet(f"{folder}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")).alias("t"))
    for days in (30, 60):
        last.select(F.lit(None).cast("long").alias("user_id"), (F.col("t") + F.expr(f"INTERVAL {days} DAYS")).alias("t")).filter("t is not null").write.mode("append").parquet(marks)
        run_once(all_sessions(), each, check)
    return spark.read.schema("user_id long, start string, n long, batch int").parquet(out).filter("user_id is not null").drop("batch")
