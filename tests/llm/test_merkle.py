"""The manifest against its SQL and against trees built by hand."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from estrado.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Root of a list of digests and, for each of them, its siblings (left, right) level by level."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for i, a in enumerate(at):
            run, s = runs[a // 8], a % 8
            paths[i].append((run[:s], run[s + 1 :]))
            at[i] = a // 8
        level = [h(*r) for r in runs]
    return (level[0] if level else None), paths


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text), sorted."""
    by = {}
    for r in rows:
        d, text = r[0], r[4]
        low = text
        if text is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf = lambda t: h(*map(field, r[:4]), field(t))  # noqa: B023, E731
        by.setdefault(r[2], []).append((d, leaf(text), leaf(low)))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    out, tops = [], []
    for k in keys:
        by[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, paths = tree([x[1] for x in by[k]])
        tops.append((top, paths))
    root, upper = tree([t for t, _ in tops])
    for k, (top, paths), more in zip(keys, tops, upper):
        for (d, leaf, low), path in zip(by[k], paths):
            node, proof = low, ""
            for left, right in path + more:
                node, proof = h(*left, node, *right), proof + "".join(left + right)
            out.append((d, leaf, top, root, h(proof), node, node == root))
    return sorted(out, key=str)


def found(spark, tmp_path, rows):
    at = tmp_path / "sf"
    spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", 7) for r in rows], DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11(spark, str(at)).collect()), key=str)


CASES = {
    "none": [],
    "one": [(3, "s", "en", 4, "Text")],
    "null everywhere": [(None, None, None, None, None), (None, None, None, None, None), (1, None, None, None, ""), (2, "a", "", 0, "B"), (None, "s", "en", 1, "C")],
    "lone runs of a group": [(i, "s", "en", i, f"Text {i} Ä") for i in range(-2, 7)] + [(i, "s", "de", i, "T" * i) for i in range(8)],
    "many groups": [(i, None, f"l{i % 70}", i, "AbC" * (i % 5)) for i in range(300)],
    "repeated rows and ids": [(7, "s", "en", 1, "Same")] * 70 + [(7, "s", "en", 1, f"Other {i % 3}") for i in range(20)],
    "long": [(1, "s", "en", 1, "Word ä " * 200_000), (2, "s", "en", 1, "x")],
}


@pytest.mark.parametrize("name", CASES)
def test_trees_by_hand(spark, tmp_path, name):
    assert found(spark, tmp_path, CASES[name]) == plain(CASES[name])


def test_sql(spark, tiny):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{tiny}/documents.parquet'")
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    want = sorted(con.sql(f"select {cols} from ({merkle.OP11_SQL})").fetchall())
    assert sorted(tuple(r) for r in merkle.op11(spark, tiny).select(*cols.split(", ")).collect()) == want
    assert {r[-1] for r in want} == {True, False}


def test_a_proof_finds_every_change(spark):
    """A leaf that was changed, and no other, fails against the root."""
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    leaf = merkle.digest(merkle.field(F.col("text")))
    got = merkle.manifest(rows, "lang", "doc_id", leaf, F.when(F.col("doc_id") == 63, F.lit("0" * 64)).otherwise(leaf))
    bad = got.filter(merkle.folded(F.col("altered"), F.col("path")) != F.col("root")).collect()
    assert [r.key for r in bad] == [63]
