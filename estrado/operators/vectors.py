"""Retrieval and decisions on similarity.

Searches (knn, k_best, at_least, best_two, max_similarity) pack both sides into blocks of vectors; groups of blocks meet in a task, which makes products of matrices in single precision, scores what may be
among the best in double precision and in the order of the dimensions, and keeps the best of each query, so no row ever stands for a pair that is not among them.

Queries, catalogues, exemplars and axes are tables; the larger side, chunks(id, vec), is scanned once and never
shuffled whole: what a task finds is cut to k for each query before it leaves (top_k's windows are limited
per partition by Spark, and its groups are combined). The smaller side is broadcast while it is
bounded and small, and otherwise met in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot
from .components import written

#: Rows of a smaller side up to which each task takes it whole; larger ones go block by block.
SMALL_SIDE = 20_000


def against(left: DataFrame, right: DataFrame, block: int = 256) -> DataFrame:
    """Rows of left, each with every row of right as a stated set: right in blocks of rows that travel as arrays.

    right is dealt into blocks; left meets a block as one row, and its members are exploded in the task that scores
    them. left is never copied when right has one block.
    """
    n = max(1, -(-right.count() // block))
    fields = right.columns
    b = right.groupBy(F.pmod(F.xxhash64(*[F.col(c) for c in fields if c != "qvec"]), F.lit(n)).cast("int").alias("_b")).agg(F.collect_list(F.struct(*fields)).alias("_r"))
    if n * block <= SMALL_SIDE:
        b = F.broadcast(b)
    l = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0))
    return l.join(b, "_b").drop("_b").withColumn("_r", F.explode("_r")).select(*left.columns, *[F.col("_r")[c].alias(c) for c in fields])


#: Vectors of a packed block; blocks of queries and of vectors, at most, that meet in a group.
PACKED = 1024
ASKED_BLOCKS, BLOCKS = 32, 16
#: Stands for a label that is null.
NONE = -(2**63)
#: Queries whose products with all vectors of a group are at hand at once, the vectors that their first bound comes from, and pairs that are scored at once.
AT_ONCE, HEAD, PAIRS = 256, 2048, 1 << 17


def packed(rows: DataFrame, id_: str, vec: str, label: str | None = None, floors: str | None = None, size: int | None = None) -> DataFrame:
    """(block, ids, labels, floors, single, m) of rows with a vector: about size of them (PACKED) in a block, m their matrix; written. All vectors have one length.

    m holds single precision where that loses nothing. floors is a column of arrays of one length, which are laid end to end.
    """
    more = F.col(floors) if floors else F.array().cast("array<double>")
    rows = rows.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(label or id_).cast("long"), F.lit(NONE)).alias("label"), more.alias("floors"), F.transform(vec, lambda x: x.cast("double")).alias("vec")).filter("vec is not null and id is not null")
    n = max(1, -(-rows.count() // (size or PACKED)))
    g = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("id", "label", "floors", "vec"))).alias("r"))

    def run(batches):
        for b in batches:
            for block, r in zip(b.column(0).to_pylist(), b.column(1)):
                f = r.values
                m = f.field("vec").flatten().to_numpy(zero_copy_only=False).astype(float)
                with np.errstate(over="ignore"):
                    half = m.astype(np.float32)
                single = bool((half == m).all())
                lists = [pa.array([f.field(name).to_pylist()], pa.list_(pa.int64())) for name in ("id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([f.field("floors").flatten().to_pylist()], pa.list_(pa.float64())), pa.array([single]), pa.array([(half if single else m).tobytes()], pa.binary())], names=["block", "ids", "labels", "floors", "single", "m"])

    return written(g.mapInArrow(run, "block long, ids array<long>, labels array<long>, floors array<double>, single boolean, m binary"), "vectors")


class Rows:
    """Rows of some packed blocks: ids, labels, floors, and their vectors in double precision (x) and as products are first looked over (rough)."""

    def __init__(self, blocks: pa.Table):
        c = {name: blocks.column(name).to_pylist() for name in blocks.column_names}
        self.ids, self.labels = (np.array([i for r in c[name] for i in r], np.int64) for name in ("ids", "labels"))
        self.x = np.concatenate([np.frombuffer(m, np.float32 if single else float).astype(float).reshape(len(r), -1) for m, single, r in zip(c["m"], c["single"], c["ids"])])
        self.floors = np.array([x for r in c["floors"] for x in r]).reshape(len(self.ids), -1)
        #: By dimension.
        self.t = np.ascontiguousarray(self.x.T)
        #: Other columns, a value for each block.
        self.more = c

    def rough(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in single precision and their lengths; in double where they are too large for it."""
        fits = np.abs(self.x).max(initial=0.0) < 1e15
        return self.x.astype(np.float32) if fits else self.x, np.sqrt((self.x**2).sum(axis=1))


def exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of rows a with rows b of two matrices given by dimension, summed in the order of the dimensions as SQL does: equal vectors tie."""
    s = np.zeros(len(a))
    for at in range(0, len(a), PAIRS):
        i, j, part = a[at : at + PAIRS], b[at : at + PAIRS], s[at : at + PAIRS]
        for p, q in zip(x, y):
            part += p[i] * q[j]
    return s


def looked_over(q: Rows, v: Rows):
    """(from, to, products, how far they may lie off by query) of AT_ONCE queries at a time with all vectors."""
    (x, far), (y, long_) = q.rough(), v.rough()
    finite = x.dtype == y.dtype == np.float32
    unsure = (x.shape[1] + 8) * 2.0**-22 * long_.max(initial=0.0)
    for lo in range(0, len(x), AT_ONCE):
        hi = min(lo + AT_ONCE, len(x))
        s = x[lo:hi] @ y.T
        if not finite:
            s[np.isnan(s)] = -np.inf
        yield lo, hi, s, far[lo:hi] * unsure + 1e-30


def of_groups(queries: DataFrame, vectors: DataFrame, keep, schema: str, most: int = BLOCKS) -> DataFrame:
    """What keep(queries, vectors) gives as columns of schema for all packed rows: blocks are dealt into groups on either side, and each two groups meet in one call. Of vectors most numbers of blocks are a group.

    A block travels once for each group of the other side, so neither side goes to every task and no task holds more than two groups.
    """
    nq, nv = (int(d.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]) + 1 for d in (queries, vectors))
    calls = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = -(-nq // ASKED_BLOCKS)
    columns = max(-(-nv // most), min(nv, -(-calls // rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    names = ["ids", "labels", "floors", "single", "m"]
    q = queries.select(F.pmod("block", F.lit(rows)).alias("i"), every(columns).alias("j"), *names)
    names += [c for c in vectors.columns if c not in (*names, "block")]
    v = vectors.select(every(rows).alias("i"), F.pmod("block", F.lit(columns)).alias("j"), *names)
    out = [c.split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return pa.table([pa.array(c, t) for c, t in zip(keep(Rows(left), Rows(right)), empty.schema.types)], names=out)

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    empty = pa.table([pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")], names=out)
    return q.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(run, schema)


def _k_best(k: int, part, parts: int, others: bool):
    """Of each query the k best of each part, of equals the smaller ids. part(labels of queries in rows, labels of vectors in columns) numbers the parts; with others a query never meets its own id."""

    def keep(q: Rows, v: Rows):
        found = []
        n, head = len(v.ids), min(HEAD, len(v.ids))
        order = np.argsort(v.ids, kind="stable")
        begin, end = (np.searchsorted(v.ids[order], q.ids, side) for side in ("left", "right"))
        asked, labels = (x.astype(np.int32) if np.abs(x.astype(float)).max(initial=0) < 2**31 else x for x in (q.labels, v.labels))
        for lo, hi, s, off in looked_over(q, v):
            if others:
                for i in lo + np.flatnonzero(end[lo:hi] > begin[lo:hi]):
                    s[i - lo, order[begin[i] : end[i]]] = -np.inf
            of = np.broadcast_to(part(asked[lo:hi, None], labels[None]), s.shape)
            for p in range(parts):
                # at least k lie over the k-th of some of them
                least = np.full(hi - lo, -np.inf)
                if head >= k:
                    least = np.partition(np.where(of[:, :head] == p, s[:, :head], -np.inf), head - k, axis=1)[:, head - k].astype(float)
                few = np.flatnonzero(np.isneginf(least))
                own = of[few] == p
                enough = own.sum(axis=1) >= k
                if enough.any():
                    least[few[enough]] = np.partition(np.where(own[enough], s[few[enough]], -np.inf), n - k, axis=1)[:, n - k]
                bound = np.where(np.isneginf(least), np.inf, least - 2 * off)
                a, b = np.nonzero(s >= bound[:, None].astype(s.dtype))
                mine = of[a, b] == p
                i, j = np.nonzero(own[np.isneginf(least[few])])  # where there are fewer than k, all are kept
                i = few[np.isneginf(least[few])][i]
                a, b = np.r_[a[mine], i], np.r_[b[mine], j]
                real = ~np.isneginf(s[a, b])
                a, b = a[real], b[real]
                sim = exact(q.t[:, lo:hi], v.t, a, b)
                at = np.lexsort((v.ids[b], -sim, a))
                a, b, sim = a[at], b[at], sim[at]
                first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
                at = np.arange(len(a))
                best = at - np.maximum.accumulate(np.where(first, at, 0)) < k
                a, b, sim = a[best] + lo, b[best], sim[best]
                found.append((q.ids[a], q.labels[a], np.full(len(a), p, np.int32), v.ids[b], v.labels[b], sim))
        return [np.concatenate(c) for c in zip(*found)]

    return keep


FOUND = "qid long, qlabel long, part int, id long, label long, sim double"


def k_best(queries: DataFrame, vectors: DataFrame, k: int, part=lambda q, v: np.zeros((1, 1), np.int64), parts: int = 1, others: bool = False, most: int = BLOCKS) -> DataFrame:
    """(qid, qlabel, part, id, label, sim, rank) of packed queries and vectors: of each query the k best of each part, ties to the smaller id.

    part(labels of queries in rows, labels of vectors in columns) numbers the parts; with others a query never meets its own id.
    """
    best = ranked(of_groups(queries, vectors, _k_best(k, part, parts, others), FOUND, most), ["qid", "part"], k, "id")
    return best.withColumns({c: F.nullif(c, F.lit(NONE)) for c in ("qlabel", "label")})


def at_least(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, id, label, sim) of all pairs of packed queries and vectors of different ids that reach the query's floor for the vector's label: labels number the floors."""

    def keep(q: Rows, v: Rows):
        found = []
        for lo, hi, s, off in looked_over(q, v):
            floors = q.floors[lo:hi]
            a, b = np.nonzero(s >= (floors - 2 * off[:, None]).astype(s.dtype)[:, v.labels])
            sim = exact(q.t[:, lo:hi], v.t, a, b)
            ok = (sim >= floors[a, v.labels[b]]) & (q.ids[lo + a] != v.ids[b])
            found.append((q.ids[lo + a[ok]], v.ids[b[ok]], v.labels[b[ok]], sim[ok]))
        return [np.concatenate(c) for c in zip(*found)]

    return of_groups(queries, vectors, keep, "qid long, id long, label long, sim double")


def _best_of_label(q: Rows, v: Rows):
    """Of each query the best product of each label."""
    order = np.lexsort((v.ids, v.labels))
    labels, x, t = v.labels[order], v.x[order], v.t[:, order]
    begin = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]).tolist()
    found = []
    for lo in range(0, len(q.ids), AT_ONCE):
        y = q.x[lo : lo + AT_ONCE]
        s = y @ x.T
        at = np.stack([b + s[:, b:e].argmax(axis=1) for b, e in zip(begin, [*begin[1:], len(labels)])], axis=1)
        a = np.repeat(np.arange(len(y)), len(begin))
        found.append((q.ids[lo + a], labels[at.ravel()], exact(q.t[:, lo : lo + AT_ONCE], t, a, at.ravel())))
    return [np.concatenate(c) for c in zip(*found)]


def ranked(scored: DataFrame, by: list[str], k: int, id_: str, score: str = "sim", name: str = "rank") -> DataFrame:
    """The k best of each group, ties to the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), id_)
    return scored.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def knn(queries: DataFrame, chunks: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """(qid, id, sim, rank) of queries(qid, qvec) over chunks(id, vec, ...): the filter comes before the ranking."""
    c = chunks if where is None else chunks.filter(where)
    return k_best(packed(queries, "qid", "qvec"), packed(c, "id", "vec"), k).select("qid", "id", "sim", "rank")


def best_two(queries: DataFrame, exemplars: DataFrame) -> DataFrame:
    """(qid, persona, s1, s2): the best and second best person, a number, by their best exemplar(persona, evec); s2 is 0 where there is one person alone."""
    e = exemplars.withColumn("_id", F.monotonically_increasing_id())
    s = of_groups(packed(queries, "qid", "qvec"), packed(e, "_id", "evec", "persona"), _best_of_label, "qid long, persona long, sim double")
    each = s.groupBy("qid", F.nullif("persona", F.lit(NONE)).cast(exemplars.schema["persona"].dataType).alias("persona")).agg(F.max("sim").alias("sim"))
    two = ranked(each, ["qid"], 2, "persona")
    return two.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("persona"))).alias("persona"), F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("s1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("sim"))), F.lit(0.0)).alias("s2")
    )


def with_margin(two: DataFrame, least: float, margin: float) -> DataFrame:
    """persona only where s1 reaches least and leads by margin."""
    ok = (F.col("s1") >= least) & (F.col("s1") - F.col("s2") >= margin)
    return two.withColumn("persona", F.when(ok, F.col("persona")))


def random_pairs(rows: DataFrame, pairs: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """(by, pares, media, error): the mean product of pairs of rows(id, vec) drawn at random, of each value of by if it is given, and its standard error.

    One side of the pairs are the rows of the least hash, in its order, the other side those of another hash: any two rows are as likely a pair as any others, a row never meets itself, no other pairs are formed,
    and runs agree whatever the partitions. A group gives pairs of them at most, what its rows allow if they are fewer.
    """
    key = F.col(by) if by else F.lit(0)
    r = rows.select(key.alias("g"), "id", "vec")

    def side(name: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(F.lit(f"{seed}{name}"), "id"), "id"))
        return r.withColumn("k", k).filter(F.col("k") <= pairs).select("g", "k", F.col("id").alias(f"{name}_id"), F.col("vec").alias(name))

    x, y = side("a").alias("x"), side("b").alias("y")
    p = x.join(y, F.col("x.g").eqNullSafe(F.col("y.g")) & (F.col("x.k") == F.col("y.k"))).filter("a_id <> b_id")
    s = p.select("x.g", dot("a", "b").alias("sim"))
    g = s.groupBy("g").agg(F.count(F.lit(1)).alias("pares"), F.avg("sim").alias("media"), (F.coalesce(F.stddev("sim"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("error"))
    return g.withColumnRenamed("g", by) if by else g.drop("g")


def max_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, sim, qid): of each left(id, vec) the best of right(qid, qvec)."""
    s = of_groups(packed(left, "id", "vec"), packed(right, "qid", "qvec"), _k_best(1, lambda q, v: np.zeros((1, 1), np.int64), 1, False), FOUND).select(F.col("qid").alias("id"), F.col("id").alias("nq"), "sim")
    return s.groupBy("id").agg(F.max(F.struct(F.col("sim"), (-F.col("nq")).alias("nq"))).alias("m")).select("id", F.col("m.sim").alias("sim"), (-F.col("m.nq")).alias("qid"))


def positions(chunks: DataFrame, axes: DataFrame, pool: int = 80, floor: float = 0.20, least: int = 3) -> DataFrame:
    """Where each group stands on each axis, for all (group, axis) at once.

    chunks(id, grupo, vec); axes(eje, subject, direction, mid, half). Of a group's chunks the pool most like the subject and
    over the floor count, weighted by that likeness: their centroid is projected on the direction and clipped to -1..1.
    Fewer than least: no score. confidence is alta from 20 chunks, media from 8, else baja.
    """
    s = against(chunks, axes).withColumn("sim", dot("subject", "vec"))
    top = ranked(s, ["grupo", "eje"], pool, "id").filter(F.col("sim") >= floor).withColumn("proj", dot("vec", "direction"))
    # the projection of a weighted mean is the weighted mean of projections
    g = top.groupBy("grupo", "eje").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(F.col("sim") * F.col("proj")) / F.sum("sim")).alias("p"), F.first("mid").alias("mid"), F.first("half").alias("half"),
        F.min(F.struct("proj", "id"))["id"].alias("evid_min"), F.min(F.struct((-F.col("proj")).alias("m"), F.col("id")))["id"].alias("evid_max"),
    )
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("p") - F.col("mid")) / F.col("half")))
    conf = F.when(F.col("n") < least, "sin_datos").when(F.col("n") >= 20, "alta").when(F.col("n") >= 8, "media").otherwise("baja")
    return g.select("grupo", "eje", "n", F.when(F.col("n") >= least, F.round(clipped, 3)).alias("score"), conf.alias("confianza"), "evid_min", "evid_max")
