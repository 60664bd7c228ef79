"""Vector math on array columns, in double precision and in the order of the dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n = F.sqrt(n)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def mean_vector(df: DataFrame, by: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """(by, centroid): the (weighted) mean of each dimension, by a sum for each (group, dimension) that is combined before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    e = df.select(*by, w.alias("_w"), F.posexplode(vec).alias("_i", "_x"))
    m = e.groupBy(*by, "_i").agg((F.sum(F.col("_w") * F.col("_x").cast("double")) / F.sum("_w")).alias("_m"))
    g = m.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_l"))  # one entry for each dimension
    return g.select(*by, F.transform("_l", lambda x: x["_m"]).alias("centroid"))
