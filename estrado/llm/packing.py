"""Best-fit packing, planned on a histogram of lengths.

Documents are cut into pieces of at most the capacity. What the plan sees is how many pieces there are of
each length: at most capacity numbers, whatever the size of the input. Best-fit goes down the
lengths; sequences with equal room are one entry (first sequence, how many), so a thousand
pieces of a length take their places in one step. The plan is a list of runs: the pieces of a length
whose ranks lie in [lo, hi) take the places of sequences first, first + 1, ..., per of them each, from offset base on.
Pieces then take their places by their rank within their length.

Ranks are dealt in parts: a piece falls by a hash of its row's number into one of the parts of its length, of which there is one for each PART pieces; counts of the
parts (small) are summed up, and only within a part are pieces numbered one by one. So a length that a third of all pieces share is no
single task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own_names, release, small_batches, table, with_defaults, written
from .tokens import default_path, slices, words

CAPACITY = 4096
#: Pieces of a length that are numbered together, about.
PART = 1_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, lo, hi, first, per, base) of best-fit decreasing over counts[length]."""
    rooms: dict[int, list[list[int]]] = {}
    open_, runs, used = np.zeros(capacity + 1, bool), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms.setdefault(room, []).append([first, n])
            open_[room] = True

    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = length + int(np.argmax(open_[length:])) if open_[length:].any() else 0
            if room:
                first, n = rooms[room][-1]
            else:
                first, n = used, -(-left // (capacity // length))
            base = capacity - room if room else 0
            per = (capacity - base) // length
            full = min(n, left // per)
            if not full:  # the last pieces do not fill one sequence
                full, per = 1, left
            runs.append((length, rank, rank + full * per, first, per, base))
            if room:
                rooms[room][-1] = [first + full, n - full]
                if n == full:
                    rooms[room].pop()
                if not rooms[room]:
                    open_[room] = False
            else:
                used += full
            put(capacity - base - per * length, first, full)
            left -= full * per
            rank += full * per
    return runs


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text): only documents over the capacity are cut."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        w = words(tokenizer)
        for b in batches:
            for a, k in slices(b.column(1)):
                ids, counts = w.encode(b.column(1).slice(a, k))
                n = -(-counts // capacity)
                of = np.repeat(np.arange(k), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[of] - start, capacity)
                at = (np.cumsum(counts) - counts)[of] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, k).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                # what a slice took goes before the next: two workers and their executor share its memory
                del ids, raw
                release()
        w.clear()  # the worker lives on for other stages
        release()

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """items with sequence_id and offset; lengths lie in 1..capacity. Any other columns pass through under any name.

    items are written with a number for each row, so that rows that are equal fall into different parts.
    """
    spark = items.sparkSession
    row, n_parts, part, count, base, own, rank, runs_, run_, i = own_names(items, "row", "parts", "part", "count", "base", "own", "rank", "runs", "run", "i")
    items_ = written(items.withColumn(row, F.monotonically_increasing_id()), "pieces")
    hist = {r[0]: r[1] for r in items_.groupBy(length).agg(F.count(F.lit(1))).collect()}  # at most capacity rows
    runs = plan(hist, capacity)
    # a row for each length: bounded by the capacity
    by_length: dict[int, list] = {}
    for r in runs:
        by_length.setdefault(r[0], []).append(r[1:])
    parts = spark.createDataFrame([(k, max(1, n // PART)) for k, n in hist.items()], f"`{length}` long, {n_parts} long")
    places = spark.createDataFrame(list(by_length.items()), f"`{length}` long, {runs_} array<struct<lo:bigint,hi:bigint,first:bigint,per:bigint,base:bigint>>")
    dealt = items_.join(F.broadcast(parts), length).withColumn(part, F.pmod(F.xxhash64(row), F.col(n_parts))).drop(n_parts)
    before = dealt.groupBy(length, part).agg(F.count(F.lit(1)).alias(count))
    before = before.withColumn(base, F.coalesce(F.sum(count).over(Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy(length, part).orderBy(row)) - 1
    ranked = dealt.withColumn(own, number).join(before.drop(count), [length, part]).withColumn(rank, F.col(own) + F.col(base))
    run = F.filter(runs_, lambda r: (r["lo"] <= F.col(rank)) & (F.col(rank) < r["hi"]))[0]
    out = ranked.join(F.broadcast(places), length).withColumn(run_, run).withColumn(i, F.col(rank) - F.col(f"{run_}.lo"))
    return out.select(
        *[F.col(f"`{c}`") for c in items.columns],
        (F.col(f"{run_}.first") + F.floor(F.col(i) / F.col(f"{run_}.per"))).cast("long").alias("sequence_id"),
        (F.col(f"{run_}.base") + (F.col(i) % F.col(f"{run_}.per")) * F.col(length)).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of docs(doc_id, text).

    Null text counts as empty and is one piece, its end id. A document that repeats (doc_id and all) is
    packed as often as it stands there; a null doc_id is packed like any other. An empty table gives no rows.
    """
    return place(pieces(docs, tokenizer, capacity), capacity)


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text"), default_path())
