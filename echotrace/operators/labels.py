"""Smallest reachable label per vertex: what confines order-dependent steps to independent parts of the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .skew import hot_keys, salted_lookup


def smallest_labels(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, label): the smallest id each id is linked to by the undirected edges (a, b), its own loops included.

    Labels spread to neighbours and then jump to the label of their label, so chains take logarithmic rounds. Minimum per
    vertex is aggregated map-side. Null ends link nothing.
    """
    e = edges.where("a is not null and b is not null").select("a", "b")
    e = cut_lineage(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    hot = cut_lineage(hot_keys(e, "b", e.count()))
    for _ in range(rounds):
        near = salted_lookup(e, labels.withColumnRenamed("id", "b"), "b", hot, F.col("a"), "inner").groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels.id == near.a).select("id", "label", F.least("label", "m").alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("label").alias("far"))
        spread = cut_lineage(spread)
        new = cut_lineage(salted_lookup(spread, jump, "m", hot_keys(spread, "m", spread.count()), F.col("id"), "inner").select("id", F.col("label").alias("old"), F.least("m", "far").alias("label")))
        done = new.where("old <> label").limit(1).count() == 0
        labels = new.select("id", "label")
        if done:
            return labels
    raise RuntimeError("labels did not settle")


#: Up to so many rows are linked within one task; more by rounds of joins. The result is the same.
ONE_TASK = 5_000_000


def _linked(member: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct members, and the smallest member of the group of each."""
    ids, m = np.unique(member, return_inverse=True)
    _, k = np.unique(key, return_inverse=True)
    label = np.arange(len(ids))
    while True:
        low = np.full(k.max(initial=-1) + 1, len(ids))
        np.minimum.at(low, k, label[m])
        new = label.copy()
        np.minimum.at(new, m, low[k])
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def linked_by_keys(df: DataFrame, member: str, key: str) -> DataFrame:
    """(member, label): label is alike for BIGINT members that share a key, directly or through others. Null members and keys link nothing.

    Members without a key are left out.
    """
    rows = cut_lineage(df.select(F.col(member).alias("m"), F.col(key).alias("k")).where("m is not null and k is not null").distinct())
    if rows.count() <= ONE_TASK:

        def run(batches):
            got = pd.concat([pd.DataFrame({"m": [], "k": []}, dtype="int64"), *batches])
            ids, label = _linked(got["m"].to_numpy(dtype=np.int64), got["k"].to_numpy())
            yield pd.DataFrame({member: ids, "label": label})

        return cut_lineage(rows.coalesce(1).mapInPandas(run, f"{member} bigint, label bigint"))
    first = rows.groupBy("k").agg(F.min("m").alias("b"))
    labels = smallest_labels(rows.join(first, "k").select(F.col("m").alias("a"), "b"))
    return labels.select(F.col("id").alias(member), "label")
