"""Groups of directly or indirectly linked records, by randomised graph contraction.

Each round every vertex hooks to the first vertex of its closed neighbourhood in a fresh pseudo-random order; edges are
relabelled with the chosen vertices, loops and repetitions fall away, and the expected number of vertices shrinks by a
constant factor, so the rounds grow with the logarithm of the input whatever the shape (chains included). At the end the
mappings of all rounds are expanded backwards. Nothing is collected: a round's edges and mapping are cut into the shared
checkpoint folder, and only their counts reach the driver.

The order of a round is a bijection of 64-bit labels, so "first neighbour" is a plain MIN over BIGINT (hash aggregation
with map-side partials: a vertex with a third of all edges is no hot spot) and no two labels can ever collide.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators.skew import HOT_PARTS, salted_lookup
from ..session import cut_lineage, drop_path, table

#: Rounds allowed; 64 contract any graph that fits into 64-bit ids with a vast margin.
MAX_ROUNDS = 64
_SHIFTS = [(13, 7, 17), (21, 35, 4), (11, 29, 14), (9, 27, 18), (23, 13, 38)]  # each makes x^=x<<a; x^=x>>>b; x^=x<<c a bijection


def reorder(c: Column, round_no: int) -> Column:
    """A bijection of BIGINT, another one each round: xor with a random constant and an xorshift step.

    Each line names its input twice, so it is bound by a lambda, lest nested calls grow exponentially.
    """
    rnd = random.Random(7919 * (round_no + 1))
    k = F.lit(rnd.getrandbits(63))
    a, b, d = rnd.choice(_SHIFTS)
    let = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    c = let(c.bitwiseXOR(k), lambda x: x.bitwiseXOR(F.shiftleft(x, a)))
    c = let(c, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, b)))
    return let(c, lambda x: x.bitwiseXOR(F.shiftleft(x, d)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, group_id) for every id that an edge links to another: group_id is the smallest id of its group.

    An edge with a null end or two equal ends links nothing; repeated and reversed edges count once; no edges, no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v")
    maps: list[DataFrame] = []
    used: list[str] = []
    cur, last_edges = e, []
    for i in range(MAX_ROUNDS):
        x, y = reorder(F.col("u"), i), reorder(F.col("v"), i)
        paths: list[str] = []
        cur, seen = _written(
            cur.select(x.alias("u"), y.alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), paths, n=F.count(F.lit(1))
        )
        for path in last_edges:  # the round before is no longer needed
            drop_path(spark, path)
        last_edges, n = paths, seen["n"]
        if n == 0:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mapping, seen = _written(
            both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")).select("u", F.least("u", "m").alias("r"), "deg"), used, deg=F.max("deg")
        )
        maps.append(mapping.select("u", "r"))
        look = mapping.select("u", "r")
        # At most HOT_PARTS vertices can hold more than 2n/HOT_PARTS edge ends each; where none does, there is nothing to salt.
        limit = max(1, 2 * n // HOT_PARTS)
        hot = mapping.where(F.col("deg") > limit).select("u") if seen["deg"] > limit else None
        meet = lambda left, spread: left.join(look, "u") if hot is None else salted_lookup(left, look, "u", hot, spread, "inner")  # noqa: B023,E731
        half = meet(cur, F.col("v")).select(F.col("v").alias("u"), F.col("r").alias("ru"))
        full = meet(half, F.col("ru")).select(F.col("ru").alias("u"), F.col("r").alias("v"))
        cur = full.where("u <> v")
    else:
        raise RuntimeError(f"{n} edges are left after {MAX_ROUNDS} rounds")

    last = len(maps)
    forward = lambda c, i: reduce(lambda acc, j: reorder(acc, j), range(i, last), c)  # noqa: E731  from labels of round i-1
    final: DataFrame | None = None  # labels of round i -> labels after the last round
    for i in range(last - 1, -1, -1):
        if final is None:
            final = maps[i]
            continue
        # A label that many vertices took is a hot key of the left side only, which adaptive execution splits.
        step = maps[i].select(F.col("u").alias("from"), reorder(F.col("r"), i + 1).alias("u"))
        final, _ = _written(step.join(final, "u", "left").select(F.col("from").alias("u"), F.coalesce("r", forward(F.col("u"), i + 2)).alias("r")), used)
    if final is None:
        return e.select(F.col("u").alias("id"), F.col("u").alias("group_id")).limit(0)
    ids = e.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("u", reorder(F.col("id"), 0))
    # Each vertex meets its one label, and each group the least of its own: a minimum with map-side partials.
    named, seen = _written(ids.join(final, "u").select("id", "r"), [], n=F.count(F.lit(1)))
    for path in used:
        drop_path(spark, path)
    sizes = cut_lineage(named.groupBy("r").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")))
    hot = sizes.where(F.col("n") > max(1, seen["n"] // HOT_PARTS)).select("r")
    return salted_lookup(named, sizes.select("r", "group_id"), "r", hot, F.col("id"), "inner").select("id", "group_id")


def _written(df: DataFrame, paths: list[str], **aggs: Column) -> tuple[DataFrame, dict]:
    """The written table, and aggregates observed while it was written."""
    if not aggs:
        return cut_lineage(df, paths), {}
    seen = Observation()
    out = cut_lineage(df.observe(seen, *(c.alias(k) for k, c in aggs.items())), paths)
    return out, seen.get


def instance_links(matches: DataFrame, clones: DataFrame) -> DataFrame:
    """(a, b): the two ends of each match, and neighbours in each clone's list of distinct instances."""
    ids = F.array_sort(F.array_distinct(F.transform(F.filter("instances", lambda x: x["instance_id"].isNotNull()), lambda x: x["instance_id"])))
    chains = clones.select(ids.alias("l")).where(F.size("l") > 1)
    pairs = chains.select(F.explode(F.arrays_zip(F.expr("slice(l, 1, size(l) - 1)").alias("a"), F.expr("slice(l, 2, size(l) - 1)").alias("b"))).alias("p"))
    return matches.select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b")).where("a <> b").union(pairs.select("p.a", "p.b"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(instance_links(table(spark, sf_dir, "fuzzy_matches"), table(spark, sf_dir, "clones")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each instance that a match or a clone row links to another, with the smallest instance of its group."""
    return _found(spark, sf_dir).select(F.col("id").alias("instance_id"), "group_id")


def p2_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    return _found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


_GROUPS = """
  WITH RECURSIVE c AS (SELECT DISTINCT clone_id, x.instance_id AS id FROM (SELECT clone_id, unnest(instances) AS x FROM clones) WHERE x.instance_id IS NOT NULL),
  l AS (SELECT a_idx AS a, b_idx AS b FROM fuzzy_matches WHERE a_idx <> b_idx
    UNION SELECT m, id FROM (SELECT id, min(id) OVER (PARTITION BY clone_id) AS m FROM c) WHERE m <> id),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r(id, g) USING KEY (id) AS (SELECT a, least(a, min(b)) FROM e GROUP BY a
    UNION SELECT e.b, min(r.g) FROM r JOIN e ON e.a = r.id JOIN recurring.r AS old ON old.id = e.b WHERE r.g < old.g GROUP BY e.b)
"""
QUERIES = {"p2_found": p2_found, "p2_group_sizes": p2_group_sizes}
ORACLES = {
    "p2_found": _GROUPS + "SELECT id AS instance_id, g AS group_id FROM r",
    "p2_group_sizes": _GROUPS + "SELECT size, count(*) AS n_groups FROM (SELECT g, count(*) AS size FROM r GROUP BY g) GROUP BY size",
}
