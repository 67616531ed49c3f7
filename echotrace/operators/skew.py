"""Joins and ranks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A key is hot when it holds more than one HOT_PARTS-th of the rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 1000
#: A hot key's rows are spread over this many sub-keys.
SALTS = 64


def hot_keys(df: DataFrame, key: str, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """Keys that hold more than total/parts rows: fewer than `parts` rows whatever the input, counted map-side first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > max(1, total // parts)).select(key)


def salted_lookup(
    big: DataFrame, dim: DataFrame, key: str | Sequence[str], hot: DataFrame, spread: Column, how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Equi-join `big` with `dim` (at most one row per key) on the column or columns `key`, splitting the keys in `hot`.

    Rows of a hot key get one of `salts` sub-keys from `spread`, and the key's single row in `dim` is repeated for
    each, so no task gets more than a `salts`-th of a hot key. `hot` must be bounded (see hot_keys) as it is broadcast.
    Null keys match nothing, as in any equi-join. Columns of the two sides other than `key` must differ.
    """
    keys = [key] if isinstance(key, str) else list(key)
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    b = big.join(marks, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    ).drop("_hot")
    d = dim.join(marks, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return b.join(d, [*keys, "_salt"], how).drop("_salt")


def rank_within(df: DataFrame, key: str, order: str, salts: int = SALTS) -> DataFrame:
    """Add `rank`, a gap-free number from 0 within each `key`, without gathering a key in one task.

    Rows are split by a hash of `order` (which should be unique); each part is numbered by `order`, and starts after the
    parts before it. The numbering is the same at any parallelism. Ties in `order` are numbered arbitrarily.
    """
    from pyspark.sql import Window

    parts = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    sizes = parts.groupBy(key, "_part").count()
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(key, "_part").orderBy(order)
    return (
        parts.withColumn("_n", F.row_number().over(inner) - 1)
        .join(starts, [key, "_part"])
        .withColumn("rank", (F.col("_n") + F.col("_start")).cast("bigint"))
        .drop("_part", "_n", "_start")
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition on `key` into spark.sql.shuffle.partitions parts that adaptive execution leaves alone.

    For stages whose cost is work per row, not bytes: few bytes would be coalesced into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def top_within(df: DataFrame, key: str, order: str, n: int, salts: int = SALTS) -> DataFrame:
    """The n rows of each `key` that are lowest by `order`, first within each of `salts` parts of a key and then among what they leave."""
    from pyspark.sql import Window

    parts = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    few = parts.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))).where(F.col("_n") <= n)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= n).drop("_part", "_n")


#: Ranges that prefix sums are split into.
RANGES = 1000


def prefix_sums(df: DataFrame, order: str, value: str, key: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Add `before`, the sum of `value` over the rows of the same `key` (or all) with a lower `order`, a number unique within it.

    In two levels: the orders of each key are cut into at most ranges+1 ranges, whose sums are few; then rows are summed within their range.
    """
    from pyspark.sql import Window

    keys = [key] if key else []
    span = df.groupBy(*keys).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    if key:
        wide = df.join(span, keys)
    else:
        low, high = span.first()
        wide = df.withColumn("_low", F.lit(low).cast("bigint")).withColumn("_high", F.lit(high).cast("bigint"))
    parts = wide.withColumn("_width", F.floor((F.col("_high") - F.col("_low")) / ranges) + 1).withColumn("_range", F.floor((F.col(order) - F.col("_low")) / F.col("_width")).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum")).select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(starts, [*keys, "_range"]).withColumn("before", (F.coalesce(F.sum(value).over(within), F.lit(0)) + F.col("_start")).cast("bigint"))
    return out.drop("_low", "_high", "_width", "_range", "_start")


def rank_in_walk(df: DataFrame, path: str, key: str | None = None, tie: str | None = None, depth: int = 3) -> DataFrame:
    """Add `rank`, the place from 1 of each row of a `key` (or all) in a directory walk: paths compared part by part, ties by `tie`.

    Paths that begin with the same `depth` parts stand together in a walk; such stretches are counted first, then numbered within, so no task
    gets all paths of a key.
    """
    from pyspark.sql import Window

    keys = [key] if key else []
    rows = df.withColumn("_parts", F.split(path, "/")).withColumn("_head", F.slice("_parts", 1, depth))
    before = Window.partitionBy(*keys).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_head").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_head", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_head").orderBy("_parts", *([tie] if tie else []))
    numbered = rows.withColumn("_no", F.row_number().over(within))
    on = starts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_head").alias("_h"), "_start")
    cond = F.col("_head").eqNullSafe(F.col("_h"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return numbered.join(on, cond).withColumn("rank", F.col("_no") + F.col("_start")).drop("_parts", "_head", "_no", "_h", "_start", *(f"_k_{k}" for k in keys))
