"""Centroid clustering in whole numbers, over blocks in Hilbert order with zone maps.

1. A first pass sums the vectors and their products, exactly one row of partial sums for each task; the principal axes of those sums turn
   the vectors, and a Hilbert curve through AXES of them, of BITS bits each, gives a key. Rows are dealt by ranges of the key.
2. Neighbours on the curve are packed into blocks of BLOCK vectors, each with its box: the least and the greatest value of every component, and with its sum.
3. In each round a block first meets the centroids with its box alone. A centroid leaves if its least distance to the box is above another's greatest one, or if it is
   farther than another from the corner of the box that favours it most: the difference of two squared distances is linear, so it is then farther from every vector.
   What is left are the block's candidates; if one is left, the block goes to it as a whole, by its stored sum.
4. The vectors are compared with the candidates exactly, a block at a time, and a task hands in one row of sums for each centroid.

The key orders the work and no more: results are those of every vector against every centroid.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, table, with_defaults, written

AXES = 8
BITS = 8
BLOCK = 256
#: Squared distances of 64 such components stay below 2**62.
LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of vectors with exactly dims components, none null or non-finite.

    A component of which the scaled value is LARGEST or more in size raises an error, as distances would leave 64 bits.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    small = F.forall("v", lambda c: F.abs(c) < LARGEST)
    got = vectors.filter(F.size(F.coalesce(x, F.array().cast("array<float>"))) == dims).filter(~bad).select("vec_id", scaled.alias("v"))
    return got.select("vec_id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit("component too large for exact distances"))).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _moments(dims: int):
    """One row of a task's count, sums and products: floats, as they only choose axes."""

    def run(batches):
        n, s, p = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column(0), dims).astype(float)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            m = np.concatenate([[n], s, p.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(m)], names=["at", "m"])

    return run


def axes_of(points: DataFrame, dims: int, axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, principal axes and spreads along them: of dims squared sums, whatever the number of points."""
    got = points.select("v").mapInArrow(_moments(dims), "at int, m double").groupBy("at").agg(F.sum("m").alias("m")).collect()
    if not got:
        return None
    m = np.zeros(1 + dims + dims * dims)
    for r in got:
        m[r["at"]] = r["m"]
    mean = m[1 : dims + 1] / m[0]
    cov = m[dims + 1 :].reshape(dims, dims) / m[0] - np.outer(mean, mean)
    spread, turn = np.linalg.eigh(cov)
    return mean, turn[:, ::-1][:, :axes], np.sqrt(np.maximum(spread[::-1][:axes], 1e-12))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (unsigned, below 2**bits); bits times columns is at most 63.

    From the highest bit down, a cell with the bit set turns the lower bits of the first axis over, one without exchanges them between its axis and the first;
    Gray code then joins the bits of all axes.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _keyed(dims: int, frame, bits: int):
    mean, turn, spread = frame
    top = (1 << bits) - 1

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dims)
            # three spreads to each side; what lies farther out shares the last cell
            at = ((x - mean) @ turn / spread / 6 + 0.5) * top
            key = hilbert(np.clip(np.floor(at), 0, top).astype(np.int64), bits)
            rows = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), pa.array(rows, pa.binary())], names=["key", "vec_id", "m"])

    return run


BLOCKS = "ids array<long>, m binary, lo binary, hi binary, total binary"
_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("m", "lo", "hi", "total")]])


def _pack(dims: int, size: int):
    def rows(ids, held):
        m = np.frombuffer(b"".join(held), "<i4").reshape(-1, dims)
        pack = lambda x: [np.ascontiguousarray(x, "<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([m.tobytes()]), *map(pa.array, (pack(m.min(0)), pack(m.max(0)), pack(m.sum(0, dtype=np.int64))))], schema=_BLOCKS)

    def run(batches):
        ids, held = [], []
        for b in batches:
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                held.append(m)
                if len(ids) == size:
                    yield rows(ids, held)
                    ids, held = [], []
        if ids:
            yield rows(ids, held)

    return run


def blocks(points: DataFrame, dims: int, size: int = BLOCK, axes: int = AXES, bits: int = BITS) -> DataFrame | None:
    """The points in blocks of size neighbours on the Hilbert curve, with their boxes and sums, written; None if there is no point.

    Equal keys are dealt by a hash of the id and by the row's place, so that any number of equal vectors is many tasks.
    """
    frame = axes_of(points, dims, min(axes, dims))
    if frame is None:
        return None
    keyed = small_batches(points).mapInArrow(_keyed(dims, frame, bits), "key long, vec_id long, m binary")
    keyed = written(keyed.withColumn("row", F.monotonically_increasing_id()), "hilbert_keys")
    order = ["key", F.xxhash64("vec_id"), "row"]
    dealt = keyed.repartitionByRange(partitions(points), *order).sortWithinPartitions(*order)
    return written(dealt.select("vec_id", "m").mapInArrow(_pack(dims, size), BLOCKS), "blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be the nearest to a vector in the box from lo to hi, exactly and in whole numbers."""
    near = np.maximum(np.maximum(lo - c, c - hi), 0)
    far = np.maximum(abs(lo - c), abs(hi - c))
    near, far = (near * near).sum(1), (far * far).sum(1)
    left = np.flatnonzero(near <= far.min())
    if len(left) > 1:
        # against the one that is nearest to the middle of the box, at the corner that favours the other most
        twice = 2 * c[left] - (lo + hi)
        best = c[left[np.argmin((twice * twice).sum(1))]]
        corner = np.where(c[left] > best, hi, lo)
        gap = ((corner - c[left]) ** 2).sum(1) - ((corner - best) ** 2).sum(1)
        left = left[gap <= 0]
    return left


def _assigned(x: np.ndarray, c: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids left for each row, ties to the smaller number, and its squared distance."""
    d = np.stack([((x - c[j]) ** 2).sum(1) for j in left], axis=1)
    best = d.argmin(1)
    return left[best], d[np.arange(len(x)), best]


def _open(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["m"], "<i4").reshape(-1, dims).astype(np.int64), np.frombuffer(row["lo"], "<i8"), np.frombuffer(row["hi"], "<i8")


def _sums(centroids: np.ndarray):
    """A task's sums and counts for each centroid, as rows (cluster, component, sum); component dims is the count."""
    k, dims = centroids.shape

    def run(batches):
        s, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for row in b.to_pylist():
                x, lo, hi = _open(row, dims)
                left = candidates(lo, hi, centroids)
                if len(left) == 1:
                    s[left[0]] += np.frombuffer(row["total"], "<i8")
                    n[left[0]] += len(x)
                    continue
                of, _ = _assigned(x, centroids, left)
                for j in left:
                    mine = of == j
                    s[j] += x[mine].sum(0)
                    n[j] += mine.sum()
        at = np.flatnonzero(n)
        if len(at):
            every = np.concatenate([s[at], n[at, None]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(dims + 1), len(at)).astype(np.int32)), pa.array(every.ravel())], names=["cluster", "at", "sum"])

    return run


def _labels(centroids: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("compared", pa.int32())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                x, lo, hi = _open(row, centroids.shape[1])
                left = candidates(lo, hi, centroids)
                of, d = _assigned(x, centroids, left)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(of.astype(np.int32)), pa.array(d), pa.array(np.full(len(x), len(left), np.int32))], schema=schema)

    return run


def seeds(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k points of the least sha256 of salt and id; rows that share an id by their components, a null id after all others. Fewer points: all of them."""
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r["v"] for r in points.orderBy(h.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def cluster(points: DataFrame, dims: int, k: int, rounds: int, salt: str = "") -> tuple[DataFrame, np.ndarray] | None:
    """Labels (vec_id, cluster, distance, compared), written, and the final centroids; None if there are no points.

    points is (vec_id, v array<long>) with dims components. compared is the number of candidates of the vector's block. The driver holds k centroids and their sums, nothing that grows with the
    points. Vectors that repeat count as often as they stand there; the nearest centroid of the smaller number wins a tie; a centroid without vectors stays where it is.
    """
    packed = blocks(points, dims)
    if packed is None:
        return None
    centroids = seeds(points, k, salt)
    for _ in range(rounds):
        got = packed.mapInArrow(_sums(centroids), "cluster int, at int, sum long").groupBy("cluster", "at").agg(F.sum("sum").alias("sum")).collect()
        every: dict[int, dict[int, int]] = {}
        for r in got:
            every.setdefault(r["cluster"], {})[r["at"]] = r["sum"]
        centroids = centroids.copy()
        for j, s in every.items():
            centroids[j] = [s[i] // s[dims] for i in range(dims)]
    return written(packed.select("ids", "m", "lo", "hi").mapInArrow(_labels(centroids), "vec_id long, cluster int, distance long, compared int"), "labels"), centroids


def op12(spark, sf_dir: str) -> DataFrame:
    """Eight clusters of embeddings after ten rounds. Vectors with nulls, other lengths or non-finite components take no part; an empty table gives no rows."""
    points = whole_numbers(with_defaults(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 64, 1024)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    got = cluster(points, 64, 8, 10, "3:")
    if got is None:
        return spark.createDataFrame([], out)
    labels, centroids = got
    sha = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    each = labels.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # eight rows at most
    every = each.agg(F.sum("cluster_inertia").alias("inertia"))
    few = each.join(sha, "cluster").crossJoin(every)
    return labels.join(F.broadcast(few), "cluster").select(*[c.split()[0] for c in out.split(", ")])


def _rounds(n: int) -> str:
    near = "(SELECT k.cluster FROM c{0} k ORDER BY list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - k.v[i]) ** 2))::BIGINT, k.cluster LIMIT 1)"
    steps = []
    for r in range(n):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.v, {near.format(r)} AS cluster FROM p)")
        floor = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
        steps.append(f"m{r} AS (SELECT cluster, list(y ORDER BY i) AS v FROM (SELECT cluster, i, {floor} AS y FROM (SELECT cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{r}) GROUP BY cluster, i) GROUP BY cluster)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    steps.append(f"l AS MATERIALIZED (SELECT p.vec_id, p.v, {near.format(n)} AS cluster FROM p)")
    return ", ".join(steps)


OP12_SQL = f"""
WITH p AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM p
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) <= 8
), {_rounds(10)}, d AS (
  SELECT l.vec_id, l.cluster, list_sum(list_transform(range(1, 65), lambda i: (l.v[i] - c.v[i]) ** 2))::BIGINT AS distance, sha256(array_to_string(c.v, ',')) AS centroid_sha256
  FROM l JOIN c10 c USING (cluster)
)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d
"""
