"""Exact top-k inner products: the three-phase uniform threshold.

The dimensions are cut into LISTS lists. A list is stored, read and scored by its own tasks: they see their own
dimensions of a vector alone, and a vector's score is the sum over the lists.

1. Every list hands in its k best entries for each query. The exact scores of the vectors so
   named give a safe cutoff: the k-th best of them, which no member of the answer falls below.
2. The cutoff divided by the number of lists goes out to all lists. A vector at or above the
   cutoff has, in one list at least, a score of that share or more, so the lists hand in all such
   entries and nothing else can be in the answer. A list hands in one packed row for each pair of blocks.
3. An entry's vector may score at most what its lists handed in plus the share for each list that
   was silent. Pairs of blocks with vectors that this bound leaves meet with all their dimensions, only the vectors
   left are scored, and a pair of blocks hands in its k best for each query, of which the k best are the answer.

Vectors travel in packed blocks of at most BLOCK rows, and every block of queries meets every
block of vectors once in each list; a task holds one block of each. No row stands for a single pair of query and vector before the last step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, with_defaults, written

LISTS = 2
BLOCK = 4096
QUERY_BLOCK = 1024
PIECE = 128


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component; null, empty or non-finite vectors are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    keep = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(~bad)
    return keep.select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


BLOCKS = "base long, block long, list int, ids array<long>, m binary, width int"
_BLOCKS = pa.schema([("base", pa.int64()), ("block", pa.int64()), ("list", pa.int32()), ("ids", pa.list_(pa.int64())), ("m", pa.binary()), ("width", pa.int32())])


def _pack(n: int, size: int, cut: list[int]):
    """Rows (base, vec_id, v), sorted by base, into packed blocks: one row for each list of a block, at most size vectors each."""

    def rows(base, part, ids, vectors):
        m = np.zeros((len(ids), cut[-1]), np.int64)
        for i, v in enumerate(vectors):
            m[i, : len(v)] = v
        top = int(np.abs(m).max(initial=0))
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        for j, (a, z) in enumerate(zip(cut, cut[1:])):
            yield {"base": base, "block": base + n * part, "list": j, "ids": ids, "m": m[:, a:z].astype(f"<i{width}").tobytes(), "width": width}

    def run(batches):
        now, part, ids, held = None, 0, [], []
        for b in batches:
            out = []
            for k, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)):
                if ids and (k != now or len(ids) >= size):
                    out += rows(now, part, ids, held)
                    part = part + 1 if k == now else 0
                    ids, held = [], []
                now = k
                ids.append(i)
                held.append(v)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_BLOCKS)
        if ids:
            yield pa.RecordBatch.from_pylist(list(rows(now, part, ids, held)), schema=_BLOCKS)

    return run


def blocks(vectors: DataFrame, rows: int, size: int, cut: list[int]) -> tuple[DataFrame, int]:
    """Vectors dealt into n bases of about size rows by a hash of the id, each base packed into blocks; and n."""
    n = max(1, -(-rows // size))
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("base"), "vec_id", "v")
    dealt = dealt.repartition(max(1, min(n, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "base").sortWithinPartitions("base", "vec_id")
    return small_batches(dealt).mapInArrow(_pack(n, 2 * size, cut), BLOCKS), n


def _open(ids: list[int], m: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.array(ids, np.int64)
    return i, np.frombuffer(m, f"<i{width}").reshape(len(i), -1).astype(np.int64)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Local scores, exact: floats hold all integers below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top >= 2**62:
        raise OverflowError("scores beyond 64 bits")
    return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if top < 2**53 else q @ c.T


ENTRY = "query_id long, list int, vec_id long, part long"


def _best(k: int):
    """Phase 1 in a list: for every pair of blocks, the k best entries of each query by the list's own scores."""
    schema = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("vec_id", pa.int64()), ("part", pa.int64())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                qi, q = _open(row["q_ids"], row["q_m"], row["q_width"])
                ci, c = _open(row["c_ids"], row["c_m"], row["c_width"])
                m = min(k + 1, len(ci))  # one more than k: the query's own row may be among them
                for a in range(0, len(qi), PIECE):
                    s = _product(q[a : a + PIECE], c)
                    y = np.argpartition(-s, m - 1, axis=1)[:, :m].ravel()
                    x = np.repeat(np.arange(len(s)), m)
                    keep = qi[a + x] != ci[y]
                    x, y = x[keep], y[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(qi[a + x]), pa.array(np.full(len(x), row["list"], np.int32)), pa.array(ci[y]), pa.array(s[x, y])], schema=schema)

    return run


HEARD = "q_block long, c_block long, list int, at binary, part binary"


def _heard(batches):
    """Phase 2 in a list: for every pair of blocks one packed row of the entries that reach their query's share."""
    schema = pa.schema([("q_block", pa.int64()), ("c_block", pa.int64()), ("list", pa.int32()), ("at", pa.binary()), ("part", pa.binary())])
    for b in batches:
        out = []
        for row in b.to_pylist():
            qi, q = _open(row["q_ids"], row["q_m"], row["q_width"])
            ci, c = _open(row["c_ids"], row["c_m"], row["c_width"])
            share = np.array(row["shares"], np.float64)
            at, part = [], []
            for a in range(0, len(qi), PIECE):
                s = _product(q[a : a + PIECE], c)
                x, y = np.nonzero((s >= share[a : a + PIECE, None]) & (qi[a : a + PIECE, None] != ci[None, :]))
                at.append((a + x) * len(ci) + y)
                part.append(s[x, y])
            at, part = np.concatenate(at), np.concatenate(part)
            if len(at):
                out.append({"q_block": row["q_block"], "c_block": row["c_block"], "list": row["list"], "at": at.astype("<i4").tobytes(), "part": part.astype("<i8").tobytes()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _resolve(k: int, lists: int):
    """Phase 3 for a pair of blocks: bounds of the entries handed in, exact scores of what they leave, the k best of each query."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def whole(side):
        parts = sorted(side, key=lambda x: x["list"])
        return np.array(parts[0]["ids"], np.int64), np.concatenate([_open(p["ids"], p["m"], p["width"])[1] for p in parts], axis=1)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                qi, q = whole(row["q"])
                ci, c = whole(row["c"])
                share = np.array(row["shares"], np.float64)
                at, entry = np.unique(np.concatenate([np.frombuffer(h["at"], "<i4") for h in row["heard"]]), return_inverse=True)
                known, heard = np.zeros(len(at), np.int64), np.bincount(entry, minlength=len(at))
                np.add.at(known, entry, np.concatenate([np.frombuffer(h["part"], "<i8") for h in row["heard"]]))
                x, y = at // len(ci), at % len(ci)
                silent = heard < lists
                bound = known + np.where(silent, (lists - heard) * np.where(silent, share[x], 0.0), 0.0)
                least = share[x] * lists
                left = bound >= least - 1e-9 * np.where(np.isfinite(least), np.abs(least), 0.0)
                x, y, score, silent = x[left], y[left], known[left], np.flatnonzero(silent[left])
                for a in range(0, len(silent), 1 << 15):
                    s = silent[a : a + (1 << 15)]
                    score[s] = np.einsum("ij,ij->i", q[x[s]], c[y[s]])
                # the k best of each query in this pair of blocks, ties to the smaller id
                order = np.lexsort((ci[y], -score, x))
                x, y, score = x[order], y[order], score[order]
                first = np.searchsorted(x, x, side="left")
                top = np.arange(len(x)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[x[top]]), pa.array(ci[y[top]]), pa.array(score[top])], schema=schema)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query, ties to the smaller vec_id.

    Both tables are (vec_id, v array<long>); a query never meets the row of its own id. Vectors
    of unequal length are compared as if padded with zeros. Fewer than k vectors: all of them.
    A vec_id that repeats in vectors counts once for each row; one that repeats in queries is asked once, with the least of its vectors.
    An empty table gives no rows.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    count = lambda d: d.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    (n_q, d_q), (n_c, d_c) = count(queries), count(vectors)
    cut = np.linspace(0, max(d_q or 0, d_c or 0, lists), lists + 1).astype(int).tolist()
    (qb, _), (cb, n) = blocks(queries, n_q, QUERY_BLOCK, cut), blocks(vectors, n_c, BLOCK, cut)
    qb, cb = written(qb, "query_blocks"), written(cb, "vector_blocks")
    own = ("ids", "m", "width")
    c_side = cb.select("list", F.col("base").alias("c_base"), F.col("block").alias("c_block"), *[F.col(c).alias(f"c_{c}") for c in own])

    def in_lists(q_side: DataFrame, *more: str) -> DataFrame:
        """Every block of queries with every block of vectors, a list at a time."""
        bases = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("c_base")
        asking = q_side.select("list", F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in own], *more, bases)
        return asking.join(c_side, ["list", "c_base"])

    # 1: the lists' own best, and a cutoff from the exact scores of what they name: some rows for each query
    first = in_lists(qb).mapInArrow(_best(k), ENTRY)
    local = Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "vec_id")
    named = first.withColumn("r", F.row_number().over(local)).filter(F.col("r") <= k).select("query_id", "vec_id").distinct()
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    exact = named.join(vectors.select("vec_id", "v"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "vec_id", product.alias("score"))
    ranked = exact.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    cutoff = written(ranked.filter(F.col("r") == k).select("query_id", F.col("score").alias("cutoff")), "cutoffs")

    # 2: the cutoff goes out with the query blocks, as an array in the blocks' own order
    ids = qb.filter("list = 0").select("block", F.posexplode("ids").alias("pos", "query_id"))
    share = ids.join(cutoff, "query_id", "left").withColumn("share", F.coalesce(F.col("cutoff") / F.lit(float(lists)), F.lit(float("-inf"))))
    shares = share.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "share"))), lambda x: x["share"]).alias("shares"))
    shares = written(shares, "shares")
    heard = written(in_lists(qb.join(shares, "block"), "shares").mapInArrow(_heard, HEARD), "heard")

    # 3: what the bound leaves is scored exactly, a pair of blocks at a time
    pair = heard.groupBy("q_block", "c_block").agg(F.collect_list(F.struct("list", "at", "part")).alias("heard"))
    side = lambda d, name: d.groupBy("block").agg(F.collect_list(F.struct("list", *own)).alias(name)).withColumnRenamed("block", f"{name}_block")
    pair = pair.join(side(qb, "q"), "q_block").join(shares.withColumnRenamed("block", "q_block"), "q_block").join(side(cb, "c"), "c_block")
    best = small_batches(pair).select("q", "c", "shares", "heard").mapInArrow(_resolve(k, lists), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    v = quantised(with_defaults(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return top_k(v.filter(F.col("vec_id") % 50 == 0), v)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
