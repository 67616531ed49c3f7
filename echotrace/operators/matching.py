"""Greedy disjoint matching without a sequential pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def greedy_matching(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """The pairs (a, b, score) that a pass in the order (score desc, a, b) would take, each vertex being used once.

    The order is total, so a pair that is the best left for both its ends is taken by the pass; such pairs are taken and
    pairs with used ends dropped until none is left. Self pairs and pairs with nulls are left out; of repeated pairs the best counts.
    """
    p = pairs.where("a <> b and score is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
    left, taken = cut_lineage(p), []
    for _ in range(rounds):
        if left.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, taken) if taken else left
        order = F.struct((-F.col("score")).alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
        ends = left.select(F.explode(F.array("a", "b")).alias("v"), order.alias("o")).groupBy("v").agg(F.min("o").alias("o"))
        best = cut_lineage(ends.groupBy("o").count().where("count = 2").select(F.col("o.x").alias("a"), F.col("o.y").alias("b"), (-F.col("o.s")).alias("score")))
        used = best.select(F.explode(F.array("a", "b")).alias("v"))
        left = cut_lineage(left.join(used.withColumnRenamed("v", "a"), "a", "left_anti").join(used.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b", "score"))
        taken.append(best)
    raise RuntimeError("matching did not settle")
