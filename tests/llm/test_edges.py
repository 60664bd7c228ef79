"""Nulls in every column, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from estrado.llm import binary, fingerprints, html, langid, mixing, packing, quality, simhash, suffixes, tokens, topk
from estrado.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, block int, key string, size string"
LONG = "palabra larga de un texto sin fin " * 3000
ROWS = [
    (1, "the water of the house and the land", "en", "a", 30, "x", 1, "k", "s"),
    (1, "the water of the house and the land", "en", "a", 30, "x", 1, "k", "s"),
    (2, None, None, None, None, None, None, None, None),
    (None, "la casa y el agua de la tierra", "es", None, 3, "x", 1, "k", "s"),
    (3, "", "es", "b", 0, "x", 1, "k", "s"),
    (4, " \n\t ", None, "b", 4, "x", 1, "k", "s"),
    (5, LONG, "es", "c", len(LONG), "x", 1, "k", "s"),
    (6, LONG, "es", "c", len(LONG), "x", 1, "k", "s"),
    (6, "la casa y el agua", "es", "c", 17, "x", 1, "k", "s"),
    (7, "12 34 !!", "xx", "d", 8, "x", 1, "k", "s"),
    (-8, "日本語 😀 \u0000 é", None, "日", 9, "x", 1, "k", "s"),
]


@pytest.fixture(scope="module", params=["messy", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "messy" else [], DOCS).repartition(3)


def test_operators_take_all_rows(spark, docs):
    n = docs.count()
    labels = docs.select("doc_id", F.when(F.col("doc_id") > 2, 1).otherwise(0).alias("quality"))
    path = tokens.default_path()
    assert suffixes.remove_repeats(docs).count() == n
    assert fingerprints.fingerprints(docs).count() == n
    assert langid.predict(docs.drop("score"), langid.fit(docs)).count() == n
    assert langid.predict(docs, langid.fit(docs)).columns[-2:] == ["lang_pred", "score"]
    assert simhash.near_duplicates(docs).count() == n
    assert quality.score(docs, labels).count() == n
    m = mixing.mix(docs)
    assert m.count() == n and {"block", "key", "copies"} <= set(m.columns)
    packed = packing.pack(docs, path)
    assert packed.select("doc_id", "piece").distinct().count() <= packed.count() and packed.count() >= n
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("s"), F.max(F.col("offset") + F.col("length")).alias("e")).filter("s > 4096 or s <> e").isEmpty()


def test_pipeline_stages_keep_the_columns(spark, docs, tmp_path):
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or now.columns == list(corpus_pipeline.COLUMNS), name
        now = spark.createDataFrame(now.collect(), now.schema)
    if docs.isEmpty():
        assert now.isEmpty()
        return
    # the copies of a long text are one document, which the mix takes once or twice and the packer cuts
    out = now.collect()
    assert {r.doc_id for r in out} >= {1, 5} and 6 not in {r.doc_id for r in out if r.length > 100}
    assert {r.doc_id for r in out} <= {1, 5, 6, None, -8}
    whole = sum(r.length for r in out if r.doc_id == 5)
    one = len(tokens.words(tokens.default_path()).tokenizer.encode(LONG.strip(), add_special_tokens=False).ids)
    assert any(abs(whole - k * one) <= 3 * k for k in (1, 2))


def test_each_value(spark):
    d = spark.createDataFrame(ROWS, DOCS).repartition(2)
    pred = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(d.drop("score"), langid.fit(d)).collect()}
    assert pred[2, None] == ("und", 0.0) and pred[7, "12 34 !!"] == ("und", 0.0) and pred[3, ""] == ("und", 0.0)
    comp = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(d).collect()}
    assert comp[3, 0] == 2 and comp[4, 0] == 2
    rep = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.remove_repeats(d).collect()}
    assert rep[6, len(LONG)] == len(LONG) and rep[5, len(LONG)] == 0 and rep[2, 0] == 0
    kept = simhash.keep_one(d)
    assert kept.filter("doc_id in (5, 6)").filter(F.length("text") > 1000).count() == 1 and kept.columns == d.columns
    taken = mixing.mix(d).filter("text is null").collect()
    assert taken[0]["size"] == 0 and taken[0]["copies"] == 0
    nxt = {(r.doc_id, r.n_chars): r for r in fingerprints.fingerprints(d).collect()}
    assert nxt[2, 0].fingerprint == "00" and 0.3 < nxt[6, len(LONG)].near_edited < 0.7


def test_binary_files(spark, docs, tmp_path):
    """Every row comes back from the files, those without a doc_id last; no rows, no files."""
    binary.write(docs.select("doc_id", "text", "block"), str(tmp_path / "t"), tokens.default_path())
    got = binary.read(spark, str(tmp_path / "t")).toPandas().sort_values("start")
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and (not len(got) or len(list(tmp_path.glob("t/shards/*.epl"))) > 0)
    ids = [None if np.isnan(x) else int(x) for x in got.doc_id.astype(float)]
    assert ids == sorted((r.doc_id for r in rows if r.doc_id is not None)) + [None] * sum(r.doc_id is None for r in rows)
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]][: len(got)] and (got.n_tokens > 0).all()


def test_clashing_names(spark, docs):
    """Columns of any name pass through keep_one, place and mix."""
    d = docs.withColumnsRenamed({"key": "keep_id", "size": "tie", "block": "keep_k", "score": "row"})
    for kept in (simhash.keep_one(d), simhash.keep_one(d, n=5, similarity=0.8)):
        assert kept.columns == d.columns and kept.filter("keep_id is not null and keep_id <> 'k'").isEmpty()
    p = packing.place(d.select("*", F.lit(5).cast("long").alias("length"), F.lit("p").alias("part"), F.lit(1).alias("base")), 10)
    assert p.filter("part <> 'p' or base <> 1").isEmpty() and p.count() == docs.count()
    assert mixing.mix(d).filter("tie is not null and tie <> 's'").isEmpty()


def test_pages(spark):
    rows = [(1, "u", None, "t", 1), (2, None, "", "t", 2), (None, "u", "<p>x</p>" * 3, None, None), (4, "u", "<article><p>" + "word " * 20000 + "</p></article>", "t", 1)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html.extract_pages(p)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert html.extract_pages(p.limit(0)).count() == 0
    assert {r.page_id: r.n_chars for r in got.collect()} == {1: 0, 2: 0, None: 5, 4: 5 * 20000 - 1}


def test_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [float("nan"), 1.0]), (1, [None, 1.0]), (2, []), (3, [1.0]), (4, [float("inf"), 0.0]), (5, [-1.0, 0.5]), (None, [1.0, 1.0]), (0, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantised(e)
    got = sorted(map(tuple, topk.top_k(v.filter("vec_id % 50 = 0"), v).collect()))
    assert got == [(0, 1, 3, 65536), (0, 2, 5, -65536 + 65536)]
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_missing_labels_and_queries(spark, tiny):
    one = quality.fit(*(lambda x: (x, x[:, 0] * 0 + 1))(__import__("numpy").ones((5, len(quality.STATS)))))
    assert not one.rules and one.bias > 0
    assert set(QUERIES) == {"op1_html", "op2_binary", "op3_suffixes", "op4_fingerprints", "op5_langid", "op6_simhash", "op7_quality", "op8_packing", "op9_mixing", "op10_topk", "op11_merkle", "op12_clusters", "op13_lattice"}
