"""Filling containers of fixed capacity with whole texts: dominance reduction, then best fit, on the histogram of sizes.

Sizes are whole numbers up to the capacity, so however many texts there are, the instance is at most `capacity` pairs of
(size, how many). On it the Martello-Toth reduction fixes bins that dominate every alternative, many equal bins at once:
an item that nothing fits with; the item with the largest partner, when they fill the bin exactly, when no two items fit
beside it, or when no pair beside it is heavier than that partner. Best fit in decreasing order packs the remainder. The
plan says, for each size, which ranks go to which bins; each text looks its bin up by its rank among texts of its size,
which is numbered without gathering a size in one task. A text beyond the capacity fills bins of its own with all but its
last piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.skew import rank_within
from ..session import cut_lineage, table
from .tokens import with_size

#: Most container sizes of one call; each has a plan on the driver.
MOST_SPECS = 100


class _Sizes:
    """A multiset of sizes with sorted access."""

    def __init__(self, counts: dict[int, int]):
        self.n = dict(counts)
        self.keys = sorted(counts)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.keys.pop(bisect_left(self.keys, size))

    def largest_upto(self, limit: int, without: int) -> int | None:
        """The largest size <= limit, with one item of `without` set aside."""
        i = bisect_left(self.keys, limit + 1) - 1
        while i >= 0:
            s = self.keys[i]
            if s != without or self.n[s] > 1:
                return s
            i -= 1
        return None

    def smallest(self, k: int, without: int) -> int | None:
        """The sum of the k smallest items with one of `without` set aside; None if there are fewer."""
        total = 0
        for s in self.keys:
            m = min(k, self.n[s] - (s == without))
            total, k = total + m * s, k - m
            if not k:
                return total
        return None

    def best_pair(self, limit: int, without: int) -> int:
        """The heaviest sum <= limit of two items, one of `without` set aside; 0 if none."""
        keys, i, j, best = self.keys, 0, len(self.keys) - 1, 0
        has = lambda s, k: self.n[s] - (s == without) >= k
        while i <= j:
            s = keys[i] + keys[j]
            if s > limit:
                j -= 1
                continue
            if (has(keys[i], 2) if i == j else has(keys[i], 1) and has(keys[j], 1)):
                best = max(best, s)
            i += 1
        return best


def reduce_dominated(sizes: _Sizes, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Bins (how many, their sizes with counts) that some optimal packing has; their items are taken out of `sizes`."""
    fixed = []
    for w in sorted(sizes.keys, reverse=True):
        while w in sizes.n:
            room = capacity - w
            k = sizes.largest_upto(room, w)
            if k is None:
                fixed.append((sizes.n[w], ((w, 1),)))
                sizes.take(w, sizes.n[w])
                break
            two, three = sizes.smallest(2, w), sizes.smallest(3, w)
            alone = two is None or two > room
            if not (k == room or alone or ((three is None or three > room) and k >= sizes.best_pair(room, w))):
                break
            if k == w:
                m = sizes.n[w] // 2
                fixed.append((m, ((w, 2),)))
                sizes.take(w, 2 * m)
            else:
                m = min(sizes.n[w], sizes.n[k])
                if not (k == room or alone):
                    m = 1  # taking this pair may change which partner is heaviest
                fixed.append((m, ((w, 1), (k, 1))))
                sizes.take(w, m)
                sizes.take(k, m)
    return fixed


def best_fit(sizes: _Sizes, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit in decreasing order; bins with equal room are handled together. Contents are chains until the end."""
    groups: dict[int, list[list]] = {}  # room -> [how many, chain of (size, count, rest)]
    rooms: list[int] = []

    def put(room: int, n: int, chain) -> None:
        if n and room not in groups:
            insort(rooms, room)
            groups[room] = []
        if n:
            groups[room].append([n, chain])

    for w in sorted(sizes.keys, reverse=True):
        left = sizes.n[w]
        while left:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                q = capacity // w
                put(capacity - q * w, left // q, (w, q, None))
                put(capacity - (left % q) * w, 1 if left % q else 0, (w, left % q, None))
                break
            room = rooms[i]
            n, chain = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            q = min(room // w, left)  # best fit fills the chosen bin as long as the size fits
            m = min(n, left // q)
            put(room, n - m, chain)
            put(room - q * w, m, (w, q, chain))
            left -= m * q
    out = []
    for room, bins in groups.items():
        for n, chain in bins:
            inside: dict[int, int] = {}
            while chain:
                inside[chain[0]] = inside.get(chain[0], 0) + chain[1]
                chain = chain[2]
            out.append((n, tuple(inside.items())))
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """(plan, bins): rows size, r0, r1, b0, q: the items of `size` ranked r0..r1-1 go to bins b0 + (rank - r0) // q."""
    sizes = _Sizes({s: n for s, n in counts.items() if s > 0 and n > 0})
    bins = reduce_dominated(sizes, capacity) + best_fit(sizes, capacity)
    rows, used, b = [], {}, 0
    for n, inside in bins:
        for s, q in inside:
            r = used.get(s, 0)
            rows.append((s, r, r + n * q, b, q))
            used[s] = r + n * q
        b += n
    return pd.DataFrame(rows, columns=["size", "r0", "r1", "b0", "q"]).astype("int64"), b


def pieces_of(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, doc_id, piece, size, own): what is packed; own pieces fill a bin by themselves.

    A text within the capacity is piece 0 as a whole. Beyond it, pieces 0..k-1 fill a bin each and the rest, if any, is piece k.
    """
    c = F.col("capacity")
    sizes = [(int(r[0]), int(r[1])) for r in specs.select("spec_id", "capacity_tokens").limit(MOST_SPECS + 1).collect()]
    if len(sizes) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container sizes")
    # Each text once for each container size, which are literals of the plan.
    each = F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in sizes)) if sizes else F.array().cast("array<struct<spec_id:int,capacity:bigint>>")
    both = docs.select("doc_id", "n_tokens", F.explode(each).alias("spec")).select("doc_id", "n_tokens", "spec.*")
    full = F.floor(F.col("n_tokens") / c).cast("bigint")
    rest = F.col("n_tokens") - full * c
    last = F.when((rest > 0) | (full == 0), F.array(F.struct(full.alias("piece"), rest.alias("size"), F.lit(False).alias("own")))).otherwise(F.array())
    whole = F.when(full > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), full - 1), lambda i: F.struct(i.alias("piece"), c.alias("size"), F.lit(True).alias("own"))))
    return both.where("n_tokens is not null and capacity > 0").select(
        "spec_id", "capacity", "doc_id", F.explode(F.concat(F.coalesce(whole, F.array().cast("array<struct<piece:bigint,size:bigint,own:boolean>>")), last.cast("array<struct<piece:bigint,size:bigint,own:boolean>>"))).alias("p")
    ).select("spec_id", "capacity", "doc_id", "p.*")


def pack(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, doc_id, piece, n_tokens, bin_id) for docs (doc_id, n_tokens) and each container size in specs.

    Bins are numbered from 0 per spec. A text of no tokens takes no room and stands in bin 0. doc_id is unique; a null
    n_tokens or a capacity below 1 is left out. Specs are a handful of rows (their plans are made on the driver).
    """
    spark = docs.sparkSession
    specs = specs.where("capacity_tokens > 0 and spec_id is not null").dropDuplicates(["spec_id"])
    items = cut_lineage(pieces_of(docs, specs).withColumn("key", F.struct("spec_id", "own", "size")).withColumn("item", F.struct("doc_id", "piece")))
    counts = items.groupBy("spec_id", "capacity", "own", "size").count().toPandas()  # at most capacity + 1 sizes a spec
    plans, bases = [], {}
    for (spec, capacity), g in counts.groupby(["spec_id", "capacity"]):
        plan, bins = plan_bins({int(s): int(n) for s, n, own in zip(g["size"], g["count"], g["own"]) if not own}, int(capacity))
        plans.append(plan.assign(spec=int(spec)))
        bases[int(spec)] = bins
    sent = spark.sparkContext.broadcast({int(p["spec"].iloc[0]): {int(s): x[["r0", "b0", "q"]].to_numpy() for s, x in p.groupby("size")} for p in plans if len(p)})
    first_own = spark.sparkContext.broadcast(bases)

    @F.pandas_udf("bigint")
    def find(spec: pd.Series, own: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(spec), dtype=np.int64)
        frame = pd.DataFrame({"k": spec, "o": own, "s": size, "r": rank}).reset_index(drop=True)
        for (k, o, s), g in frame.groupby(["k", "o", "s"]):
            at, r = g.index.to_numpy(), g["r"].to_numpy()
            if o:
                out[at] = first_own.value[int(k)] + r
            elif s:
                p = sent.value[int(k)][int(s)]
                i = np.searchsorted(p[:, 0], r, side="right") - 1
                out[at] = p[i, 1] + (r - p[i, 0]) // p[i, 2]
        return pd.Series(out)

    ranked = rank_within(items, "key", "item")
    return ranked.select("spec_id", "doc_id", F.col("piece").cast("int").alias("piece"), F.col("size").alias("n_tokens"), find("spec_id", "own", "size", "rank").alias("bin_id"))


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")
    sized = cut_lineage(with_size(docs).select("doc_id", "n_tokens"))
    specs = table(spark, sf_dir, "pack_specs")
    return pack(sized, specs), specs


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or piece of a text beyond the capacity, for each container size."""
    return _packed(spark, sf_dir)[0]


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container size: texts, tokens, containers used, the least number possible by volume, and the share filled."""
    packed, specs = _packed(spark, sf_dir)
    cap = specs.groupBy("spec_id").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    used = packed.where("n_tokens > 0").groupBy("spec_id").agg(
        F.count_distinct("doc_id").alias("texts"), F.sum("n_tokens").alias("tokens"), (F.max("bin_id") + 1).alias("containers")
    )
    return used.join(cap, "spec_id").select(
        "spec_id", "texts", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_by_volume"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"),
    )


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container size: texts packed, whether each is there whole and once, whether no container is over its capacity, and only larger texts are split."""
    packed, specs = _packed(spark, sf_dir)
    packed = cut_lineage(packed)
    sized = cut_lineage(with_size(table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")).select("doc_id", "n_tokens"))
    cap = specs.groupBy("spec_id").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    texts = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("kinds")).join(sized, "doc_id").join(F.broadcast(cap), "spec_id")
    whole = (F.col("t") == F.col("n_tokens")) & (F.col("pieces") == F.col("kinds"))
    a = texts.groupBy("spec_id").agg(F.count(F.lit(1)).alias("texts"), F.bool_and(whole).alias("whole"), F.bool_and((F.col("pieces") == 1) | (F.col("n_tokens") > F.col("capacity"))).alias("split_if_larger"))
    b = packed.groupBy("spec_id", "bin_id").agg(F.sum("n_tokens").alias("load")).join(F.broadcast(cap), "spec_id").groupBy("spec_id").agg(F.bool_and(F.col("load") <= F.col("capacity")).alias("fits"))
    return a.join(b, "spec_id").select("spec_id", "texts", "whole", "fits", "split_if_larger")


QUERIES = {"p6_packed": p6_packed, "p6_fill": p6_fill, "p6_checks": p6_checks}
ORACLES = {
    "p6_checks": """SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IS NOT NULL) AS texts, true AS whole, true AS fits, true AS split_if_larger
      FROM pack_specs WHERE capacity_tokens > 0 GROUP BY spec_id""",
}
