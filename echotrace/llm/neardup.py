"""Near-duplicate sets under a Jaccard threshold, by segment-popcount embedding and grid range-join, exact.

A set is embedded as the counts of its members in segments of the 64-bit hash space. The Manhattan distance of two embeddings never exceeds
the size of the symmetric difference, and Jaccard >= t bounds that by d = (1-t)/(1+t)*(|A|+|B|). The segments lie in groups, and the
counts of one group are a grid cell: two sets within d agree in all but d groups at most, so among any d+1 groups there is one in which
both stand in the same cell (the range of the join, d over more than d groups, is 0 cells in at least one of them).

* Sizes are cut into bands a factor 1/t wide. Each set lies in the cells of its own band; it looks for partners no larger than itself in its
  own band and the one below, whose layouts have as many groups as any pair can need, and SPARE more.
* Of these groups a set may pass over all but d+1. It passes over those whose cells are fullest, so cells that many sets share, empty ones among
  them, are looked up only by sets that have nothing rarer. Segments are as many as there are sets, so cells stay small as the input grows.
* The distance over COARSE further segments is a cheap lower bound for each pair that met; the exact check follows.

Equal sets are joined as one class and only expanded at the end. A crowded cell is split into squares of TILE by TILE sets, so no task gets
all pairs of a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.skew import HOT_PARTS, salted_lookup
from ..session import cut_lineage, table
from .components import components

#: What a null or 0 in detect_runs.min_similarity stands for (fixed value).
DEFAULT_MIN_SIMILARITY = 0.7
#: Groups beyond those that the bound needs.
SPARE = 6
#: Below this threshold a pair may differ in more members than there are groups with any; there each member is a group by itself.
LOW = 0.5
#: Fewest segments of a group.
LEAST_SEGMENTS = 64
#: Segments of the lower bound on pairs that met.
COARSE = 32
#: Sets of a crowded cell on either side of what one task compares.
TILE = 2048
_EPS = 1e-9


def block_sets(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """(block_id, run_id, t, s): each block once, with its run's threshold and its set of values as a sorted array.

    Null and zero values are no members; a block without members, id or run is in no result. Runs without options get
    the default threshold; a threshold above 1 is met by nothing.
    """
    t = runs.where("run_id is not null").groupBy("run_id").agg(
        F.coalesce(F.nullif(F.max("min_similarity"), F.lit(0.0)), F.lit(DEFAULT_MIN_SIMILARITY)).alias("t")
    )
    s = F.array_sort(F.array_distinct(F.filter("mini", lambda x: x.isNotNull() & (x != 0))))
    return (
        blocks.where("block_id is not null and run_id is not null")
        .select("block_id", "run_id", s.alias("s"))
        .where(F.size("s") > 0)
        .groupBy("block_id").agg(F.min("run_id").alias("run_id"), F.first("s").alias("s"))
        .join(t, "run_id", "left")
        .select("block_id", "run_id", F.coalesce("t", F.lit(DEFAULT_MIN_SIMILARITY)).alias("t"), "s")
    )


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, membership): equal sets of a run become one class, named by its smallest block."""
    keyed = sets.withColumn("key", F.sha2(F.to_json(F.struct("run_id", "s")), 256))
    reps = cut_lineage(
        keyed.groupBy("key").agg(F.min("block_id").alias("rep"), F.first("run_id").alias("run_id"), F.first("s").alias("s"), F.max("t").alias("t"), F.count(F.lit(1)).alias("copies"))
    )
    # Copies of one set, however many, meet one short row: it is repeated for each salt.
    salts = 16
    members = keyed.select("block_id", "key", F.pmod(F.xxhash64("block_id"), F.lit(salts)).cast("int").alias("_salt")).join(
        reps.select("key", "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")), ["key", "_salt"]
    ).select("block_id", "rep")
    return reps, cut_lineage(members)


def popcounts(s: Column, segments: int = COARSE) -> Column:
    """Members of `s` per segment."""
    seg = F.transform(s, lambda x: F.pmod(F.xxhash64(x), F.lit(segments)))
    # Counts are capped at what a byte holds, which can only lower a distance.
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.least(F.size(F.filter(seg, lambda y: y == i)), F.lit(127)).cast("tinyint"))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda acc, x: acc + x)


_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def bands(t: float, largest: int) -> list[int]:
    """First sizes of the bands for a threshold, the last one above `largest`: a set's partners are in its band or a neighbour."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] / t - _EPS))))
    return out


def within(t: float, a: int, b: int) -> int:
    """The largest symmetric difference of sets of these sizes with Jaccard >= t."""
    return int((1 - t) / (1 + t) * (a + b) + _EPS)


def lookups(t: float, n: int, limits: list[int]) -> list[tuple[int, int, int, bool]]:
    """(band, groups of its layout, groups that a set of size n has to look up, whether it lies there) of the bands with partners up to size n.

    Below LOW there is one layout, band -1, of a group for each member: ceil(t*n) of n members at least are common.
    """
    if t < LOW:
        return [(-1, n, min(n, n - int(np.ceil(t * n - _EPS)) + 1), True)]
    own = int(np.searchsorted(limits, n, side="right")) - 1
    out = []
    for k in (own, own - 1):
        if k >= 0 and limits[k + 1] - 1 >= t * n - _EPS:
            top = limits[k + 1] - 1
            groups = within(t, int(top / t + _EPS), top) + 1 + SPARE
            out.append((k, groups, within(t, n, min(n, top)) + 1, k == own))
    return out


_CELLS = "rep bigint, n int, t double, band int, groups int, need int, own boolean, cell bigint"


def cells(reps: DataFrame, segments: int) -> DataFrame:
    """Each set's grid cells: those it lies in (own) and those below, with how many of a band's it has to look up. t >= 1 gives none."""

    def run(batches):
        plans: dict = {}
        for b in batches:
            ids, runs, ts = (np.asarray(b.column(i)) for i in range(3))
            off = np.asarray(b.column(3).offsets).astype(np.int64)
            x = np.asarray(b.column(3).values)[off[0] : off[-1]].astype(np.int64).view(_U)
            size = np.diff(off)
            rows = []  # (row, band, groups, need, own)
            for i, (t, n) in enumerate(zip(ts.tolist(), size.tolist())):
                if t < 1:
                    if (t, n) not in plans:
                        plans[t, n] = lookups(t, n, bands(t, n) if t >= LOW else [])
                    rows += [(i, *p) for p in plans[t, n]]
            if not rows:
                continue
            row, band, groups, need, own = (np.array(c) for c in zip(*rows))
            h = _mix(x + _U(0x9E3779B97F4A7C15))
            count = size[row]
            start = np.cumsum(count) - count
            member = np.repeat(off[:-1][row] - off[0] - start, count) + np.arange(int(count.sum()))
            of = np.repeat(np.arange(len(row)), count)
            base = np.cumsum(groups) - groups
            alone = band[of] < 0
            place = base[of] + np.where(alone, np.arange(len(of)) - start[of], ((h[member] >> _U(32)) % groups[of].astype(_U)).astype(np.int64))
            # The counts of a group, as a sum over its members: equal counts give equal sums.
            total = np.zeros(int(groups.sum()), dtype=_U)
            np.add.at(total, place, _mix((h[member] & _U(segments - 1)) + _U(1)))
            at = np.repeat(np.arange(len(row)), groups)
            group = np.arange(len(at)) - base[at]
            key = _mix(runs[row].astype(np.int64).view(_U) * _U(0xD6E8FEB86659FD93) + band.astype(_U))[at]
            cell = _mix(total ^ _mix(key + np.where(band[at] < 0, 0, group).astype(_U)))
            r = row[at]
            out = (ids[r], size[r].astype(np.int32), ts[r], band[at].astype(np.int32), groups[at].astype(np.int32), need[at].astype(np.int32), own[at], cell.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["rep", "n", "t", "band", "groups", "need", "own", "cell"])

    return reps.select("rep", F.col("run_id").cast("bigint"), F.col("t").cast("double"), "s").mapInArrow(run, _CELLS)


def met_pairs(reps: DataFrame) -> DataFrame:
    """(rep_a, rep_b, t): the pairs of sets that meet in a cell, each once, sizes permitting."""
    n = reps.count()
    all_cells = cells(reps, max(LEAST_SEGMENTS, 1 << max(n - 1, 1).bit_length()))
    counts = cut_lineage(all_cells.where("own").groupBy("cell").agg(F.count(F.lit(1)).alias("freq")))
    total = counts.agg(F.sum("freq")).first()[0] or 0
    # Fewer than HOT_PARTS cells can hold more than total/HOT_PARTS sets each.
    hot = counts.where(F.col("freq") > max(1, total // HOT_PARTS)).select("cell")
    known = cut_lineage(salted_lookup(all_cells, counts, "cell", hot, F.col("rep"), "inner"))
    # A cell that holds nothing but the set itself, or nothing, is looked up for free.
    full = known.where("freq > 1 or not own").groupBy("rep", "n", "t", "band", "groups", "need").agg(F.array_sort(F.collect_list(F.struct("freq", "cell"))).alias("c"))
    left_over = F.col("need") - (F.col("groups") - F.size("c"))
    side = F.ceil(F.col("freq") / TILE).cast("int")
    tiles = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    spot = F.pmod(F.xxhash64("rep"), F.col("side")).cast("int")
    left = (
        full.where(left_over > 0).select("rep", "n", "t", F.explode(F.slice("c", F.lit(1), left_over)).alias("e"))
        .select("rep", "n", "t", "e.cell", F.ceil(F.col("e.freq") / TILE).cast("int").alias("side"))
        .select(F.col("rep").alias("rep_a"), F.col("n").alias("na"), "t", "cell", spot.alias("i"), tiles("side").alias("j"))
    )
    right = known.where("own").select("rep", "n", "cell", side.alias("side")).select(F.col("rep").alias("rep_b"), F.col("n").alias("nb"), "cell", spot.alias("j"), tiles("side").alias("i"))
    return (
        left.join(right, ["cell", "i", "j"])
        .where("nb < na or nb = na and rep_b < rep_a")
        .where(F.col("nb") >= F.col("t") * F.col("na") - _EPS)
        .select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), "t")
        .distinct()
    )


def similar_classes(reps: DataFrame) -> DataFrame:
    """(rep_a, rep_b, similarity) of each pair of classes of one run with Jaccard >= their run's t, rep_a < rep_b.

    A threshold of 1 or more is met by no two different sets; one below 0 counts as 0, and sets without a common member are no pair.
    """
    full = reps.select("rep", "s", popcounts(F.col("s")).alias("p"))
    side = lambda x: full.select(F.col("rep").alias(f"rep_{x}"), F.col("s").alias(f"s{x}"), F.col("p").alias(f"p{x}"))
    sizes = F.size("sa") + F.size("sb")
    bound = (1 - F.col("t")) / (1 + F.col("t")) * sizes + _EPS
    near = met_pairs(reps).join(side("a"), "rep_a").join(side("b"), "rep_b").where(manhattan(F.col("pa"), F.col("pb")) <= bound)
    inter = F.size(F.array_intersect("sa", "sb"))
    return (
        near.select("rep_a", "rep_b", "t", inter.alias("i"), sizes.alias("m"))
        .where("i > 0")
        .select("rep_a", "rep_b", "t", (F.col("i").cast("double") / (F.col("m") - F.col("i"))).alias("similarity"))
        .where("similarity >= t")
        .select("rep_a", "rep_b", "similarity")
    )


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sets = cut_lineage(block_sets(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "detect_runs")))
    reps, members = classes(sets)
    return reps, members, similar_classes(reps)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of blocks of a run whose Jaccard similarity reaches the run's threshold; the classes' pairs expanded."""
    reps, members, pairs = _parts(spark, sf_dir)
    m = lambda x: members.select(F.col("rep").alias(f"rep_{x}"), F.col("block_id").alias(f"block_{x}"))
    own = reps.where("copies > 1 and t <= 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    both = pairs.select("rep_a", "rep_b").union(own).join(m("a"), "rep_a").join(m("b"), "rep_b")
    return both.where("rep_a <> rep_b or block_a < block_b").select(
        F.least("block_a", "block_b").alias("block_a"), F.greatest("block_a", "block_b").alias("block_b")
    )


def p4_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of different sets, each set named by its smallest block, with the similarity to six digits."""
    return _parts(spark, sf_dir)[2].select("rep_a", "rep_b", F.round("similarity", 6).alias("similarity"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per block with members: its class, the class's similar classes, and the smallest block of its group."""
    reps, members, pairs = _parts(spark, sf_dir)
    pairs = cut_lineage(pairs.select("rep_a", "rep_b"))
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    groups = components(pairs, "rep_a", "rep_b").withColumnRenamed("id", "rep")
    per_class = reps.select("rep").join(links, "rep", "left").join(groups, "rep", "left")
    return members.join(per_class, "rep").select(
        "block_id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "rep").alias("group_id")
    )


_SETS = f"""
  WITH r AS (SELECT run_id, coalesce(nullif(max(min_similarity), 0), {DEFAULT_MIN_SIMILARITY}) AS t FROM detect_runs GROUP BY 1),
  b AS (SELECT block_id, min(run_id) AS run_id, any_value(list_sort(list_distinct(list_filter(mini, lambda x: x IS NOT NULL AND x <> 0)))) AS s
    FROM blocks WHERE mini IS NOT NULL GROUP BY 1),
  s AS (SELECT b.*, coalesce(t, {DEFAULT_MIN_SIMILARITY}) AS t FROM b LEFT JOIN r USING (run_id) WHERE len(s) > 0),
  e AS (SELECT block_id, run_id, t, len(s) AS n, unnest(s) AS x FROM s),
  c AS (SELECT a.block_id AS block_a, b.block_id AS block_b, a.t, a.n + b.n AS m, count(*) AS i
    FROM e a JOIN e b ON a.run_id = b.run_id AND a.x = b.x AND a.block_id < b.block_id GROUP BY 1, 2, 3, 4),
  p AS (SELECT block_a, block_b, CAST(i AS DOUBLE) / (m - i) AS j FROM c WHERE CAST(i AS DOUBLE) / (m - i) >= t)
"""
QUERIES = {"p4_found": p4_found, "p4_class_pairs": p4_class_pairs, "p4_groups": p4_groups}
ORACLES = {
    "p4_found": _SETS + "SELECT block_a, block_b FROM p",
    "p4_class_pairs": _SETS
    + """, k AS (SELECT block_id, min(block_id) OVER (PARTITION BY run_id, s) AS rep FROM s)
      SELECT block_a AS rep_a, block_b AS rep_b, round(j, 6) AS similarity FROM p
      WHERE j < 1 AND block_a IN (SELECT rep FROM k) AND block_b IN (SELECT rep FROM k)""",
    "p4_groups": _SETS.replace("WITH r AS", "WITH RECURSIVE r AS")
    + """, k AS (SELECT block_id, min(block_id) OVER (PARTITION BY run_id, s) AS rep FROM s),
      q AS (SELECT block_a AS a, block_b AS b FROM p WHERE j < 1 AND block_a IN (SELECT rep FROM k) AND block_b IN (SELECT rep FROM k)),
      w AS (SELECT a, b FROM q UNION SELECT b, a FROM q), n AS (SELECT a, count(*) AS links FROM w GROUP BY 1),
      g(id, m) USING KEY (id) AS (SELECT a, least(a, min(b)) FROM w GROUP BY a
        UNION SELECT w.b, min(g.m) FROM g JOIN w ON w.a = g.id JOIN recurring.g AS old ON old.id = w.b WHERE g.m < old.m GROUP BY w.b)
      SELECT block_id, rep AS class_id, coalesce(links, 0) AS links, coalesce(m, rep) AS group_id FROM k LEFT JOIN n ON n.a = rep LEFT JOIN g ON g.id = rep""",
}
