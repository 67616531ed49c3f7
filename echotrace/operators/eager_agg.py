"""Aggregation pushed below a join: both inputs shrink to one state per join key before they meet.

For a join on K followed by GROUP BY on columns of the left side, COUNT and SUM need only, of each input, the number of
rows and the sums per key: COUNT(*) of the join is the sum of nl*nr, SUM of a left column is the sum of sl*nr, and SUM
of a right column the sum of nl*sr. The states are built with map-side partial aggregation, so a key that holds most
rows reaches the shuffle as one row per task, and the join never sees raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def compact(df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """One row per `keys`: `{prefix}n` rows and `{prefix}sum_c` for each c of `sums` (nulls add nothing)."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{prefix}sum_{c}") for c in sums)]
    return df.groupBy(*keys).agg(*aggs)


def join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    group: Sequence[str] = (),
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
) -> DataFrame:
    """GROUP BY `group` (columns of left, may include join keys) over left JOIN right USING (`on`), without joining rows.

    Gives `n_rows` = COUNT(*) and `sum_c` for each named column. Null join keys match nothing; a side with no rows
    gives an empty result (without `group` one row of zeros). Column names of the two sides may clash outside `on`.
    """
    keys = list(dict.fromkeys([*on, *group]))
    l = compact(left.dropna(subset=list(on)), keys, left_sums, "_l_")
    r = compact(right.dropna(subset=list(on)), list(on), right_sums, "_r_")
    j = l.join(r, list(on))
    aggs = [F.coalesce(F.sum(F.col("_l_n") * F.col("_r_n")), F.lit(0)).alias("n_rows")]
    aggs += [F.sum(F.col(f"_l_sum_{c}") * F.col("_r_n")).alias(f"sum_{c}") for c in left_sums]
    aggs += [F.sum(F.col(f"_r_sum_{c}") * F.col("_l_n")).alias(f"sum_{c}") for c in right_sums]
    return j.groupBy(*group).agg(*aggs)


def distinct_bucket_sizes(df: DataFrame, keys: Sequence[str], members: Sequence[str]) -> DataFrame:
    """Number of distinct `members` per `keys` as `bucket_size`, balanced under any skew of `keys`.

    The first shuffle is on keys and members together, which no hot key can fill; from it each task sends one partial
    count per key. Rows with a null in any key or member are no members.
    """
    cols = [*keys, *members]
    return (
        df.select(*cols).dropna().distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_size"))
    )
