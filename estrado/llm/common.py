"""What the operators share: tables, the shared folder and words."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import scratch, written  # noqa: F401

#: A word, as every operator on words reads it: whatever stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker at once, so that long texts do not add up in either process.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches bounded by bytes and rows; a tighter bound of the session's own stays."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)):
        now = conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def release() -> None:
    """Gives memory that a task has freed back to the system: its worker lives on for other stages, which need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, as the session's default file system completes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it, so that an operator's columns never clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def with_defaults(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns of any name never clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
