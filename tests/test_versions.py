"""Tables that change together: old or new, never both; a killed change leaves nothing to be seen."""

import pytest
from pyspark.sql import functions as F

from estrado import catalog
from estrado.operators import versions

ROWS, FLAGS = "pleno_id long, idx long, text string", "pleno_id long, filas boolean"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROWS)


def flags(spark, *r):
    return spark.createDataFrame(list(r), FLAGS)


def both(spark, root, version=None):
    return tuple(sorted(map(tuple, d.collect())) if (d := versions.read(spark, root, t, version)) is not None else None for t in ("rows", "flags"))


def test_rows_and_flags_appear_together(spark, root):
    assert both(spark, root) == (None, None) and versions.latest(spark, root) == 0
    assert versions.change(spark, root, {"rows": (rows(spark, (1, 0, "a"), (2, 0, "b")), ["pleno_id"]), "flags": (flags(spark, (1, True), (2, True)), ["pleno_id"])}) == 1
    # all rows of a key are replaced, those of others stay; null is a key like others
    versions.change(spark, root, {"rows": (rows(spark, (1, 0, "new"), (1, 1, None), (3, 0, "c")), ["pleno_id"])})
    assert both(spark, root) == ([(1, 0, "new"), (1, 1, None), (2, 0, "b"), (3, 0, "c")], [(1, True), (2, True)])
    # an older version reads as it was
    assert both(spark, root, 1)[0] == [(1, 0, "a"), (2, 0, "b")]
    versions.change(spark, root, {"rows": (rows(spark), ["pleno_id"])})
    assert len(both(spark, root)[0]) == 4


def test_a_killed_change_is_never_seen(spark, root):
    versions.change(spark, root, {"rows": (rows(spark, (1, 0, "a")), ["pleno_id"]), "flags": (flags(spark, (1, False)), ["pleno_id"])})
    before = both(spark, root)
    # killed after the rows were written and before the flags were
    now = versions.manifest(spark, root)
    versions.prepare(spark, root, "rows", rows(spark, (1, 0, "half")), ["pleno_id"], now)
    assert both(spark, root) == before
    # resumed
    versions.change(spark, root, {"rows": (rows(spark, (1, 0, "whole")), ["pleno_id"]), "flags": (flags(spark, (1, True)), ["pleno_id"])})
    assert both(spark, root) == ([(1, 0, "whole")], [(1, True)])
    assert versions.vacuum(spark, root, keep=1) == 3 and both(spark, root) == ([(1, 0, "whole")], [(1, True)])


def test_the_second_of_two_writers_is_refused(spark, root):
    versions.change(spark, root, {"rows": (rows(spark, (1, 0, "a")), ["pleno_id"])})
    began, now = versions.latest(spark, root), versions.manifest(spark, root)
    mine = versions.prepare(spark, root, "rows", rows(spark, (1, 0, "mine")), ["pleno_id"], now)
    versions.change(spark, root, {"rows": (rows(spark, (1, 0, "theirs")), ["pleno_id"])})
    with pytest.raises(versions.Conflict):
        versions.publish(spark, root, {"rows": mine}, began)
    assert both(spark, root)[0] == [(1, 0, "theirs")]


def test_a_reader_keeps_its_version(spark, root):
    versions.change(spark, root, {"rows": (rows(spark, *[(i, 0, "old") for i in range(200)]), ["pleno_id"])})
    held = versions.read(spark, root, "rows")
    versions.change(spark, root, {"rows": (rows(spark, *[(i, 0, "new") for i in range(0, 200, 2)]), ["pleno_id"])})
    assert {r.text for r in held.collect()} == {"old"}
    assert versions.read(spark, root, "rows").groupBy("text").count().orderBy("text").collect() == [("new", 100), ("old", 100)]


def test_other_columns_are_refused(spark, root):
    versions.change(spark, root, {"rows": (rows(spark, (1, 0, "a")), ["pleno_id"])})
    with pytest.raises(ValueError, match="columns"):
        versions.change(spark, root, {"rows": (flags(spark, (1, True)), ["pleno_id"])})


def test_only_touched_buckets_are_written(spark, root):
    versions.change(spark, root, {"rows": (rows(spark, *[(i, 0, "x") for i in range(500)]), ["pleno_id"])})
    first = versions.manifest(spark, root)["rows"]["buckets"]
    versions.change(spark, root, {"rows": (rows(spark, (7, 0, "y")), ["pleno_id"])})
    second = versions.manifest(spark, root)["rows"]["buckets"]
    assert sum(first[b] != second[b] for b in second) == 1 and set(first) == set(second)
    assert versions.read(spark, root, "rows").filter(F.col("text") == "y").count() == 1


def test_ingest_with_versions(spark, tiny):
    """A run that is killed between its phases and resumed ends as one that is not."""
    got = sorted(map(tuple, catalog.QUERIES["versioned_ingest"](spark, tiny).collect()))
    want = spark.read.parquet(f"{tiny}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("n")).collect()
    assert got == sorted((r.conv_id, True, True, r.n, 2 if r.conv_id % 2 else 1) for r in want)
