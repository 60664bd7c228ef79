"""Clustering against every vector with every centroid, its curve and its boxes against what they promise."""

import hashlib

import duckdb
import numpy as np
import pytest

from estrado.llm import kmeans

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, key long"


def plain(rows, dims=64, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    name = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda p: (p[0] is None, name(p[0]) if p[0] is not None else "", p[1]))[:k]
    c = [p[1] for p in first]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, z)) for z in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        of = [nearest(v)[0] for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*mine)] if (mine := [v for (_, v), o in zip(kept, of) if o == j]) else c[j] for j in range(len(c))]
    got = [(i, *nearest(v)) for i, v in kept]
    total = sum(g[2] for g in got)
    each = {j: sum(g[2] for g in got if g[1] == j) for j in range(len(c))}
    return sorted([(i, j, d, each[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got], key=str)


def vectors(n, groups, spread, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, 64))
    return [(int(i), [float(x) for x in np.float32(centre[i % groups] + spread * r.normal(size=64))]) for i in range(n)]


CASES = {
    "none": [],
    "nothing kept": [(1, None), (2, [1.0]), (3, [float("nan")] * 64), (4, [None] * 64), (5, [float("inf")] * 64), (6, [])],
    "one": [(1, [0.5] * 64)],
    "fewer than eight": vectors(5, 5, 0.1) + [(9, None)],
    "null ids and ties": [(None, [float(i % 3)] * 64) for i in range(12)] + [(i, [float(i % 4)] * 64) for i in range(20)],
    "repeated rows": [(i % 4, [0.25] * 64) for i in range(600)] + vectors(30, 3, 0.2),
    "empty centroids": [(i, [1.0] * 64) for i in range(40)] + [(100, [-1.0] * 64)],
    "mixed": vectors(900, 9, 0.5) + [(1, None), (2, [1.0] * 63)],
}


@pytest.mark.parametrize("name", CASES)
def test_every_pair(spark, tmp_path, name):
    at = str(tmp_path / "sf")
    spark.createDataFrame([(i, v, 0, 1, 2) for i, v in CASES[name]], VECTORS).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    assert sorted((tuple(r) for r in kmeans.op12(spark, at).collect()), key=str) == plain(CASES[name])


def test_sql(spark, tiny):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{tiny}/embeddings.parquet'")
    cols = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    assert sorted(tuple(r) for r in kmeans.op12(spark, tiny).select(*cols.split(", ")).collect()) == sorted(con.sql(f"select {cols} from ({kmeans.OP12_SQL})").fetchall())


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_neighbours(axes, bits):
    cells = np.array(np.meshgrid(*[range(1 << bits)] * axes)).reshape(axes, -1).T
    key = kmeans.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    steps = abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_boxes_never_lose_the_nearest():
    r = np.random.default_rng(3)
    left = 0
    for _ in range(300):
        c = r.integers(-60, 60, (8, 4))
        x = r.integers(-60, 60, 4) + r.integers(-12, 12, (20, 4))
        got = kmeans.candidates(x.min(0), x.max(0), c)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert set(d.argmin(1)) <= set(got)
        left += len(got)
    assert left < 300 * 5


def test_boxes_leave_few_candidates_where_vectors_cluster(spark):
    rows = [(i, [int(1024 * x) for x in v]) for i, v in vectors(12_000, 8, 0.08)]  # some 47 blocks, so that few lie across two groups
    points = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4)
    labels, _ = kmeans.cluster(points, 64, 8, 3, "3:")
    got = labels.groupBy().agg({"compared": "avg"}).first()[0]
    assert got < 4, got


def test_components_beyond_exact_distances_are_an_error(spark):
    v = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        kmeans.whole_numbers(v, 64, 1024).collect()
