"""An index of vectors: coarse cells, residual codes, exact scores of what is left.

build() fits cells on a sample of SAMPLE rows of the least hash, puts every row into the cell of its nearest centre, and writes blocks of rows of one cell: ids, one signed byte for each component of the
residual, and the vectors themselves. Columns named in by become folders, so a filter on them reads only theirs.

search() asks the probe best cells of each query: groups of packed queries meet groups of blocks (vectors.py), the codes of the probed cells give approximate products, of which the best rescore * k of a
group are scored with the vectors.
recall() measures it against the exact search; with probe None all cells are asked and all rows scored, which is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import AT_ONCE, Rows, exact, k_best, of_groups, packed, ranked

#: Rows that cells are fitted on, and the most cells: what the driver and every task hold.
SAMPLE = 20_000
CELLS = 2048
BLOCK = 512
#: Rows of a cell that are packed together, about: by its share of the sample a hot cell is dealt into several tasks.
DEALT = 8192


def centres(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Means of a sample's cells, from rows of it that lie far apart on. An empty cell stays where it was."""
    cells = min(cells, len(sample))
    first, far = [0], np.full(len(sample), np.inf)
    while len(first) < cells:
        far = np.minimum(far, ((sample - sample[first[-1]]) ** 2).sum(1))
        first.append(int(far.argmax()))
    c = sample[first].copy()
    for _ in range(rounds):
        of = nearest(sample, c)
        n = np.bincount(of, minlength=cells)
        s = np.zeros_like(c)
        np.add.at(s, of, sample)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c**2).sum(1) - 2 * x[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def build(vectors: DataFrame, path: str, by: tuple[str, ...] = (), cells: int | None = None) -> int:
    """Writes the index of vectors(id, vec, *by) below path and gives the number of its cells: the root of the number of rows unless given, CELLS at most.

    Vectors of one length; rows without an id, a vector or with a null in it are left out. Rows that repeat are kept each. No row: an empty index of no cells.
    """
    v = vectors.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), *by)
    v = v.filter("id is not null and vec is not null and size(vec) > 0").filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    n = v.count()
    # the rows of the least hash lie below this, so no more than some of the others are sent to the driver, which orders them
    some = v.select("id", "vec").filter(F.xxhash64("id", "vec") < -(2**63) + int(2**64 * 1.2 * SAMPLE / n)) if n > 1.2 * SAMPLE else v.select("id", "vec")
    drawn = [r["vec"] for r in some.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).collect()]
    wanted = min(cells or max(1, int(n**0.5)), CELLS)
    c = centres(np.array(drawn), wanted) if drawn else np.zeros((0, 1))
    deals = np.maximum(1, -(-np.bincount(nearest(np.array(drawn), c), minlength=len(c)) * (n / len(drawn)) // DEALT)).astype(np.int64) if drawn else np.ones(0, np.int64)
    spark = v.sparkSession
    spark.createDataFrame([(i, x) for i, x in enumerate(c.tolist())], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cell = nearest(_rows(b.column(1)), c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(deals[cell])], names=[*b.schema.names, "cell", "deals"])

    def pack(batches):
        held, now, kinds = [], None, []

        def out():
            x = np.array([h[1] for h in held])
            r = x - c[now[-2]]
            scale = np.maximum(np.abs(r).max(1), 1e-30) / 127
            codes = np.rint(r / scale[:, None]).astype(np.int8)
            with np.errstate(over="ignore"):
                half = x.astype(np.float32)
            single = bool((half == x).all())
            cols = [pa.array([[h[0] for h in held]], pa.list_(pa.int64())), pa.array([single]), *(pa.array([z.tobytes()], pa.binary()) for z in (codes, scale, half if single else x)), pa.array([now[-2]], pa.int32()), pa.array([now[-1]], pa.int64()), *(pa.array([k], t) for k, t in zip(now[:-2], kinds))]
            return pa.RecordBatch.from_arrays(cols, names=["ids", "single", "codes", "scales", "m", "cell", "deal", *by])

        for b in batches:
            kinds = [b.schema.field(name).type for name in by]
            for i, x, *key in zip(*(z.to_pylist() for z in b.columns)):
                key = tuple(key)
                if held and (key != now or len(held) == BLOCK):
                    yield out()
                    held = []
                now = key
                held.append((i, x))
        if held:
            yield out()

    own = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in v.schema.fields if f.name in by)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = f"id long, vec array<double>{own}, cell int, deals long"
    dealt = v.mapInArrow(assign, kind).withColumn("deal", F.pmod(F.xxhash64("id"), "deals")).repartition(parts, "cell", "deal").sortWithinPartitions(*by, "cell", "deal", "id")
    blocks = dealt.select("id", "vec", *by, "cell", "deal").mapInArrow(pack, f"ids array<long>, single boolean, codes binary, scales binary, m binary, cell int, deal long{own}")
    blocks.write.partitionBy(*by).parquet(f"{path}/blocks") if by else blocks.write.parquet(f"{path}/blocks")
    return len(c)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probe: int | None, where: Column | None = None, rescore: int = 4) -> DataFrame:
    """(qid, id, sim, rank): of each queries(qid, qvec) the k best products in the probe best cells, ties to the smaller id. where is a filter on columns of the index. A query without a vector gives no row."""
    c = np.array([r["centre"] for r in spark.read.parquet(f"{path}/cells").orderBy("cell").collect()])  # CELLS rows at most
    most = len(c) if probe is None else min(probe, len(c))

    if not most:
        return spark.createDataFrame([], "qid long, id long, sim double, rank int")
    q = packed(queries.filter("size(qvec) > 0"), "qid", "qvec")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks = blocks if where is None else blocks.filter(where)
    # what was dealt together is a block of the search
    groups = max(1, -(-int(blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]) // DEALT))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("cell", "deal"), F.lit(groups)))
    none = F.array().cast("array<double>").alias("floors")
    if probe is None:
        found = k_best(q, blocks.select("block", "ids", F.col("ids").alias("labels"), none, "single", "m"), k, most=1)
        return found.select("qid", "id", "sim", "rank")

    def keep(q: Rows, v: Rows):
        found, cells = [], v.more["cell"]
        begin = np.cumsum([0, *(len(s) // 8 for s in v.more["scales"])])
        codes, scales = (np.concatenate([np.frombuffer(z, t) for z in v.more[name]]) for name, t in (("codes", np.int8), ("scales", float)))
        codes = codes.reshape(len(v.ids), -1).astype(np.float32)
        for lo in range(0, len(q.ids), AT_ONCE):
            y = q.x[lo : lo + AT_ONCE]
            near = y @ c.T
            asked = np.zeros(near.shape, bool)
            np.put_along_axis(asked, np.argsort(-near, axis=1, kind="stable")[:, :most], True, axis=1)
            s = np.full((len(y), len(v.ids)), -np.inf, np.float32)
            for cell, a, b in zip(cells, begin, begin[1:]):
                i = np.flatnonzero(asked[:, cell])
                s[i, a:b] = near[i, cell, None] + y[i].astype(np.float32) @ codes[a:b].T * scales[a:b]
            take = min(len(v.ids), rescore * k)
            least = np.partition(s, len(v.ids) - take, axis=1)[:, len(v.ids) - take]
            # those of equal codes go on together
            a, b = np.nonzero((s >= (least - 1e-6 * (1 + np.abs(least)))[:, None]) & ~np.isneginf(s))
            sim = exact(q.t[:, lo : lo + AT_ONCE], v.t, a, b)
            found.append((q.ids[lo + a], v.ids[b], sim))
        return [np.concatenate(z) for z in zip(*found)]

    v = blocks.select("block", "ids", F.col("ids").alias("labels"), none, "single", "m", "cell", "codes", "scales")
    found = of_groups(q, v, keep, "qid long, id long, sim double", most=1)
    return ranked(found, ["qid"], k, "id").select("qid", "id", "sim", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): which share of what the exact search gives was found."""
    hit = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg(F.countDistinct("qid").alias("queries"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))
