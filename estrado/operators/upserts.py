"""Tables that are rewritten by merging: upserts, point updates, deletes and deduplication.

A merge is one full outer join on the key, after the incoming side has been cut to one row a key. Which columns an
incoming row may change is a list, so each table's own rule stands where it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, key: list[str], replace: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """old with the rows of new: on conflict replace takes the new value, fill takes it unless it is null or empty, all other columns stay.

    new holds one row for each key at most. Keys that are null never meet.
    """
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    j = o.withColumn("_o", F.lit(True)).alias("o").join(n.withColumn("_n", F.lit(True)).alias("n"), on, "full")
    out = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in key:
            v = F.coalesce(a, b)
        elif c in replace:
            v = F.when(F.col("n._n"), b).otherwise(a)
        elif c in fill:
            v = F.when(F.col("n._n") & F.col("o._o"), F.coalesce(F.nullif(b, F.lit("")), a)).otherwise(F.coalesce(a, b))
        else:
            v = F.when(F.col("o._o"), a).otherwise(b)
        out.append(v.alias(c))
    return j.select(*out)


def not_yet(new: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new whose key done lacks: a second pass over the same input adds nothing."""
    return new.join(done.select(*key).distinct(), key, "left_anti")


def replace_partition(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of all old rows of their keys."""
    return not_yet(old, new, key).unionByName(new)


def consolidated(entities: DataFrame, children: DataFrame, unique: list[str], order: str) -> DataFrame:
    """children(entidad, ...) of entities(id, same, slug, short, n) that are one where same is: they point to the entity that bears the short slug, else to that with most sessions n, the smaller
    id of equals, and bear the short slug: an entity that is alone keeps its own. Of children that then share (entidad, *unique) one stays: that entity's own before others, then by order.
    """
    # the short slug is that of the first of them
    best = entities.groupBy("same").agg(F.max(F.struct((F.col("slug") == F.col("short")).alias("bears"), "n", (-F.col("id")).alias("i"), "slug")).alias("x"), F.min_by("short", "id").alias("short"), F.count(F.lit(1)).alias("many"))
    to = entities.select("id", "same").join(best, "same").select(F.col("id").alias("entidad"), (-F.col("x.i")).alias("_to"), F.when(F.col("many") > 1, F.col("short")).otherwise(F.col("x.slug")).alias("slug"))
    j = children.join(to, "entidad")
    first = F.row_number().over(Window.partitionBy("_to", *unique).orderBy(F.col("entidad") != F.col("_to"), order))
    j = j.withColumn("_k", first).filter("_k = 1").withColumn("entidad", F.col("_to"))
    return j.drop("_to", "_k")
