"""Rows that an explode makes many of are never sent to the driver, whatever Spark takes their size for."""

from pyspark.sql import functions as F

from estrado.llm import shingles, simhash


def joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {j for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin") if j in plan}


def test_keys_of_fingerprints(spark, monkeypatch):
    plans, write = {}, simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: (plans.update({name: joins(df)}), write(df, name))[1])
    fps = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.xxhash64("id")).otherwise(F.xxhash64(F.expr("id - id % 3")).bitwiseXOR(F.col("id") % 3)).alias("fp"))
    assert simhash.links(fps).count() > 0
    assert plans == {"shared": {"SortMergeJoin"}}


def test_bands_of_texts(spark):
    classes = spark.range(300).select(F.col("id").alias("fp"), F.xxhash64("id").alias("sim"), F.expr("transform(sequence(1, 24), b -> xxhash64(id div 2, b))").alias("keys"))
    stars = shingles.band_stars(classes)
    assert stars.count() == 24 * 150
    assert joins(stars) == {"SortMergeJoin"}
