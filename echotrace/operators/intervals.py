"""Intervals per key: their union, without exploding them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def merged(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, lo, hi) of the maximal intervals that the closed integer intervals of each key form; touching ones merge.

    Null or empty intervals (hi < lo) are left out. Repeated and nested intervals change nothing.
    """
    d = df.where(F.col(lo).isNotNull() & (F.col(hi) >= F.col(lo))).select(key, F.col(lo).alias("lo"), F.col(hi).alias("hi")).distinct()
    order = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    g = d.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(key, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def covered_lines(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, covered): how many integers the intervals of each key cover."""
    return merged(df, key, lo, hi).groupBy(key).agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"))


#: Lines of a bucket that intervals are met in.
BUCKET = 64


def meeting(left: DataFrame, right: DataFrame, key: str, how: str = "left_semi", contained: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Rows of `left` (key, lo, hi, ...) that share an integer with an interval of `right` (key, lo, hi), or lie within one if `contained`; how: left_semi or left_anti.

    Rows meet per key and bucket of integers, not per key alone, so long lists of one key are not compared with each other. Null or empty
    intervals meet nothing. `left` should have a column that tells its rows apart only if it repeats rows.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket)))
    r = right.where("lo <= hi").select(F.col(key).alias("_key"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
    r = r.withColumn("_cell", cells(F.col("_lo"), F.col("_hi")))
    fit = left.where("lo <= hi")
    if contained:  # an interval lies within another one that its first integer lies in
        l, hit = fit.withColumn("_cell", F.floor(F.col("lo") / bucket)), (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
    else:
        l, hit = fit.withColumn("_cell", cells(F.col("lo"), F.col("hi"))), (F.col("_lo") <= F.col("hi")) & (F.col("lo") <= F.col("_hi"))
    found = l.join(r, (F.col(key) == F.col("_key")) & (l["_cell"] == r["_cell"]) & hit, "left_semi").drop("_cell").distinct()
    if how == "left_semi":
        return found
    return left.alias("l").join(found.alias("f"), [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in left.columns], "left_anti")
