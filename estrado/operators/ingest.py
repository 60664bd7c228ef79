"""Ingest in two phases that can be resumed: rows first, vectors after, a flag for each in a table of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .upserts import replace_partition, upsert

PHASES = ("filas", "vectores")


def register(state: DataFrame, heads: DataFrame) -> DataFrame:
    """state(pleno_id, fecha, filas, vectores) with the headers that came in, heads(pleno_id, fecha): a known session takes its new date, its flags stay as they are."""
    new = heads.select("pleno_id", "fecha", *[F.lit(False).alias(p) for p in PHASES])
    return upsert(state, new, ["pleno_id"], replace=["fecha"])


def pending(state: DataFrame, phase: str) -> DataFrame:
    """(pleno_id) of the sessions that a phase still has to do: vectors only of those whose rows are in."""
    ready = F.lit(True) if phase == PHASES[0] else F.col(PHASES[0])
    return state.filter(ready & ~F.col(phase)).select("pleno_id")


def done(state: DataFrame, ids: DataFrame, phase: str) -> DataFrame:
    """state with the phase's flag set for ids(pleno_id)."""
    hit = ids.select("pleno_id").distinct().withColumn("hit", F.lit(True))
    return state.join(hit, "pleno_id", "left").withColumn(phase, F.col(phase) | F.coalesce("hit", F.lit(False))).select(*state.columns)


def run(state: DataFrame, stored: DataFrame, incoming: DataFrame, phase: str, reach: Column) -> tuple[DataFrame, DataFrame]:
    """(state, stored) after a phase over what is pending and reach, a condition on pleno_id where an interrupted run stops: all rows of a session are replaced."""
    now = pending(state, phase).filter(reach)
    return done(state, now, phase), replace_partition(stored, incoming.join(now, "pleno_id", "left_semi"), ["pleno_id"])
