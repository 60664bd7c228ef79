"""The vector index against the products of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from estrado.operators import index, vectors

SCHEMA = "id long, vec array<double>, tipo string"


def made(n, dims=16, groups=12, seed=2):
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, dims))
    x = c[r.integers(0, groups, n)] + 0.4 * r.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), "abc"[i % 3]) for i, v in enumerate(x)]


def plain(rows, queries, k, kinds="abc"):
    out = set()
    for q, y in queries:
        s = sorted((-round(float(np.dot(y, v)), 9), i) for i, v, t in rows if t in kinds)
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(s[:k])}
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = made(3000)
    path = str(tmp_path_factory.mktemp("index") / "i")
    d = spark.createDataFrame([*rows, (None, [0.0] * 16, "a"), (7000, None, "a"), (7001, [None] * 16, "b")], SCHEMA).repartition(5)
    assert index.build(d, path, by=("tipo",)) == 54
    return rows, path


def test_all_cells_are_exact(spark, stored):
    rows, path = stored
    asked = [(i, v) for i, v, _ in rows[::300]]
    q = spark.createDataFrame([*asked, (99, None)], "qid long, qvec array<double>")
    for kinds in ("abc", "b", "ac"):
        got = index.search(spark, path, q, 7, None, F.col("tipo").isin(*kinds))
        assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == plain(rows, asked, 7, kinds)


def test_recall_of_a_third_of_the_cells(spark, stored):
    rows, path = stored
    q = spark.createDataFrame([(i, v) for i, v, _ in rows[::20]], "qid long, qvec array<double>")
    exact = index.search(spark, path, q, 10, None)
    some = index.search(spark, path, q, 10, 18)
    r = index.recall(some, exact).first()
    assert r.queries == 150 and r.recall >= 0.9
    # what is found is scored exactly, and a filter leaves other folders unread
    want = {(x.qid, x.id): x.sim for x in exact.collect()}
    assert all(want[x.qid, x.id] == pytest.approx(x.sim, abs=1e-9) for x in some.collect() if (x.qid, x.id) in want)
    plan = index.search(spark, path, q, 10, 18, F.col("tipo") == "a")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tipo" in plan


def test_repeated_rows_and_a_hot_cell(spark, tmp_path):
    rows = [(i % 5, [1.0, 0.0], "a") for i in range(2000)] + [(10, [0.0, 1.0], "b")]
    d, path = spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "i")
    cells = index.build(d, path, cells=3)
    got = index.search(spark, path, spark.createDataFrame([(1, [1.0, 0.5])], "qid long, qvec array<double>"), 3, cells).collect()
    assert [(r.id, r.sim) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1.0)] * 3
    assert spark.read.parquet(f"{path}/blocks").count() > 1


def test_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    assert index.build(spark.createDataFrame([], SCHEMA), path) == 0
    assert index.search(spark, path, spark.createDataFrame([(1, [1.0])], "qid long, qvec array<double>"), 3, 4).count() == 0


def test_packed_searches_are_those_of_all_pairs(spark, monkeypatch):
    """Blocks of some rows give what every pair gives, ties to the smaller id."""
    monkeypatch.setattr(vectors, "PACKED", 37)
    rows = made(200, dims=5) + [(500 + i, made(200, dims=5)[3][1], "a") for i in range(6)]
    c = spark.createDataFrame(rows, SCHEMA)
    asked = [(i, v) for i, v, _ in rows[::9]]
    q = spark.createDataFrame(asked, "qid long, qvec array<double>")
    assert {(r.qid, r.id, r["rank"]) for r in vectors.knn(q, c, 4).collect()} == plain(rows, asked, 4)
    best = {r.id: r.qid for r in vectors.max_similarity(c.select("id", "vec"), q).collect()}
    assert best == {i: min((-round(float(np.dot(v, y)), 9), j) for j, y in asked)[1] for i, v, _ in rows}
    people = c.select((F.col("id") % 4).cast("int").alias("persona"), F.col("vec").alias("evec"))
    for r in vectors.best_two(q, people).collect():
        s = sorted(((-max(round(float(np.dot(dict(asked)[r.qid], v)), 9) for i, v, _ in rows if i % 4 == p), p) for p in range(4)))
        assert (r.persona, round(r.s1, 9), round(r.s2, 9)) == (s[0][1], -s[0][0], -s[1][0])
