"""Buckets of hashed windows: their sizes per run, and which of them exceed the run's limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashes import hex64, hex_text
from ..operators.eager_agg import compact, distinct_bucket_sizes
from ..session import table

#: What a null or 0 in detect_runs.max_bucket stands for (fixed value).
DEFAULT_MAX_BUCKET = 500
#: Sub-keys of a run when bucket states meet the run's options, as one run may hold most buckets.
RUN_SALTS = 32


def run_limits(runs: DataFrame) -> DataFrame:
    """One compact state per run: its max_bucket with the default filled in; repeated rows of a run agree."""
    return runs.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.coalesce(F.nullif(F.max("max_bucket"), F.lit(0)), F.lit(DEFAULT_MAX_BUCKET)).alias("max_bucket")
    )


def bucket_sizes(windows: DataFrame) -> DataFrame:
    """(run_id, hv, bucket_size) of each run and value; null, unreadable and zero values are no windows."""
    w = windows.select("run_id", hex64("h").alias("hv"), "file_id", "pos").where(F.col("hv") != 0)
    return distinct_bucket_sizes(w, ["run_id", "hv"], ["file_id", "pos"])


def sized_buckets(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """Compact states of both inputs joined: bucket sizes with their run's max_bucket. A run without options has the default."""
    salt = F.pmod(F.xxhash64("hv"), F.lit(RUN_SALTS)).cast("int")
    limits = run_limits(runs).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(RUN_SALTS - 1))))
    sizes = bucket_sizes(windows).withColumn("_salt", salt)
    return sizes.join(limits, ["run_id", "_salt"], "left").select(
        "run_id", "hv", "bucket_size", F.coalesce("max_bucket", F.lit(DEFAULT_MAX_BUCKET)).alias("max_bucket")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run and value whose bucket holds more distinct positions than the run's max_bucket."""
    b = sized_buckets(table(spark, sf_dir, "windows"), table(spark, sf_dir, "detect_runs"))
    return b.where("bucket_size > max_bucket").select("run_id", hex_text("hv").alias("h"))


def p1_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: buckets, positions, the largest bucket, buckets over the limit, truncation and candidate pairs.

    candidate_pairs is what a self-join on (run, h) with a < b would emit, from counts alone: the sum of n(n-1)/2.
    """
    b = sized_buckets(table(spark, sf_dir, "windows"), table(spark, sf_dir, "detect_runs"))
    n = F.col("bucket_size")
    return b.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.sum(n).alias("n_positions"),
        F.max(n).alias("largest_bucket"),
        F.sum((n > F.col("max_bucket")).cast("bigint")).alias("over_limit"),
        F.max(n > F.col("max_bucket")).alias("bucket_truncated"),
        F.sum((n * (n - 1) / 2).cast("bigint")).alias("candidate_pairs"),
    )


def p1_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and token positions of windows joined to blocks of the same run and file, per run, from compact states."""
    from ..operators.eager_agg import join_aggregate

    w = table(spark, sf_dir, "windows").select("run_id", "file_id", "pos")
    b = table(spark, sf_dir, "blocks").select("run_id", "file_id", "block_id", F.size("mini").alias("members"))
    return join_aggregate(w, b.withColumn("members", F.greatest("members", F.lit(0))), ["run_id", "file_id"], ["run_id"], ["pos"], ["members"])


_HV = "lpad(ltrim(regexp_replace(lower(trim(h)), '^0x', ''), '0'), 16, '0')"
_SIZES = f"""
  WITH w AS (SELECT DISTINCT run_id, {_HV} AS h, file_id, pos FROM windows WHERE h IS NOT NULL),
  b AS (SELECT run_id, h, count(*) AS n FROM w WHERE h <> '0000000000000000' GROUP BY 1, 2),
  r AS (SELECT run_id, coalesce(nullif(max(max_bucket), 0), {DEFAULT_MAX_BUCKET}) AS lim FROM detect_runs GROUP BY 1),
  j AS (SELECT b.*, coalesce(lim, {DEFAULT_MAX_BUCKET}) AS lim FROM b LEFT JOIN r USING (run_id))
"""

QUERIES = {"p1_found": p1_found, "p1_bucket_stats": p1_bucket_stats, "p1_join_counts": p1_join_counts}
ORACLES = {
    "p1_found": _SIZES + "SELECT run_id, h FROM j WHERE n > lim",
    "p1_bucket_stats": _SIZES
    + """SELECT run_id, count(*) AS n_buckets, CAST(sum(n) AS BIGINT) AS n_positions, max(n) AS largest_bucket,
      CAST(count(*) FILTER (n > lim) AS BIGINT) AS over_limit, max(n > lim) AS bucket_truncated,
      CAST(sum(n * (n - 1) // 2) AS BIGINT) AS candidate_pairs FROM j GROUP BY run_id""",
    "p1_join_counts": """SELECT run_id, count(*) AS n_rows, CAST(sum(pos) AS BIGINT) AS sum_pos,
      CAST(sum(coalesce(len(mini), 0)) AS BIGINT) AS sum_members
      FROM windows JOIN (SELECT run_id, file_id, mini FROM blocks) b USING (run_id, file_id) GROUP BY run_id""",
}
