"""Small inputs for the core operators: nulls, ties, repeated rows, empty tables, extra columns with clashing names."""

import os
import random

import pytest
from pyspark.sql import functions as F

from echotrace.functions.hashes import hex64, hex_text
from echotrace.functions.paths import glob_regex, in_pruned_dir
from echotrace.operators.eager_agg import join_aggregate
from echotrace.operators.intervals import merged
from echotrace.operators.skew import hot_keys, rank_within, salted_lookup
from echotrace.plans.buckets import sized_buckets

W = "run_id int, file_id int, pos int, h string, max_bucket int"
R = "run_id int, max_bucket int, h string"


def test_hex64(spark):
    rows = ["0X5488FB5726BBDC3A ", "ff", "0x00ff", " FF", "0", "0x0000", None, "", "xyz", "1ffffffffffffffff", "ffffffffffffffff"]
    got = [r.t for r in spark.createDataFrame([(r,) for r in rows], "h string").select(hex_text(hex64("h")).alias("t")).collect()]
    ff, zero = "00000000000000ff", "0" * 16
    assert got == ["5488fb5726bbdc3a", ff, ff, ff, zero, zero, None, None, None, None, "f" * 16]


def test_buckets(spark):
    w = [(1, 1, p, "AB", 0) for p in range(30)] + [(1, 1, p, " 0xab", 0) for p in range(20)] + [(1, 1, p, "0", 0) for p in range(9)]
    w += [(2, 2, 1, "c", 0), (2, 2, 1, "C", 0), (3, 1, None, "c", 0), (None, 1, 1, "c", 0), (4, 9, 9, None, 0)]
    runs = [(1, 10, "x"), (1, 10, "x"), (2, 0, "y"), (None, 3, "z")]
    got = {(r.run_id, r.hv): (r.bucket_size, r.max_bucket) for r in sized_buckets(spark.createDataFrame(w, W), spark.createDataFrame(runs, R)).collect()}
    assert got == {(1, 0xAB): (30, 10), (2, 0xC): (1, 500)}
    assert sized_buckets(spark.createDataFrame([], W), spark.createDataFrame([], R)).count() == 0


def test_join_aggregate_matches_join(spark):
    rnd = random.Random(3)
    key = lambda: rnd.choice([None, 1, 1, 1, 1, 2, 3, 4])
    a = spark.createDataFrame([(key(), rnd.randrange(3), rnd.choice([None, 5, 7])) for _ in range(200)], "k int, g int, v int")
    b = spark.createDataFrame([(key(), rnd.randrange(9), rnd.choice([None, 2])) for _ in range(150)], "k int, g int, x int")
    want = a.join(b.select("k", "x"), "k").groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("sum_v"), F.sum("x").alias("sum_x"))
    got = join_aggregate(a, b, ["k"], ["g"], ["v"], ["x"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    empty = spark.createDataFrame([], "k int, g int, x int")
    assert join_aggregate(a, empty, ["k"], ["g"]).count() == 0


def test_salted_lookup_and_rank(spark):
    rows = [(7 if i % 3 else i, i) for i in range(3000)] + [(None, -1)]
    big = spark.createDataFrame(rows, "k int, v int")
    dim = spark.createDataFrame([(i, f"d{i}") for i in range(0, 3000, 2)] + [(7, "hot")], "k int, d string")
    hot = hot_keys(big, "k", 3001)
    assert [r.k for r in hot.collect()] == [7]
    got = salted_lookup(big, dim, "k", hot, F.col("v"))
    want = big.join(dim, "k", "left")
    assert sorted(map(str, got.select("k", "v", "d").collect())) == sorted(map(str, want.select("k", "v", "d").collect()))
    ranks = {}
    for r in rank_within(big.where("k is not null"), "k", "v").collect():
        ranks.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_merged_intervals(spark):
    rows = [(1, 1, 5), (1, 6, 7), (1, 3, 4), (1, 9, 9), (1, 9, 9), (1, 12, 10), (2, None, 3), (3, 4, None), (None, 1, 2)]
    got = sorted(map(tuple, merged(spark.createDataFrame(rows, "k int, lo int, hi int"), "k").where("k is not null").collect()))
    assert got == [(1, 1, 7), (1, 9, 9)]


@pytest.mark.parametrize(
    "glob,path,hit",
    [("**/*.go", "a/b.go", True), ("**/*.{go,py}", "a/b.py", True), ("*.go", "b.go", True), ("*.go", "a/b.go", False), ("a?c", "abc", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a{b}", "a{b}", True)],
)
def test_glob(glob, path, hit):
    import re

    assert bool(re.match(glob_regex(glob), path)) == hit


def test_pruned(spark):
    rows = [("a/vendor/b.go", True), ("vendor", False), (".git/x", True), ("./a.go", False), ("src/a.go", False)]
    got = spark.createDataFrame(rows, "p string, want boolean").select(in_pruned_dir(F.col("p")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_queries_against_sql(spark):
    from echotrace.plans import registry
    from tests.oracle import compare

    sql = registry.oracle_sql()
    bad = {n: d for n, f in registry.queries().items() if (d := compare(spark, "/root/testdata/sf0.001", n, f, sql.get(n)))}
    assert not bad


def test_prefix_sums_and_walk_rank(spark):
    from echotrace.operators.skew import prefix_sums, rank_in_walk, top_within

    rnd = random.Random(3)
    rows = [(k, o, rnd.randrange(9), "x") for k in ("a", "b") for o in rnd.sample(range(-500, 5000), 300)] + [("c", 7, 2, "x")]
    df = spark.createDataFrame(rows, "k string, o bigint, v int, before string").drop("before")
    got = {(r.k, r.o): r.before for r in prefix_sums(df, "o", "v", "k", 7).collect()}
    assert got == {(k, o): sum(v for q, p, v, _ in rows if q == k and p < o) for k, o, _, _ in rows}
    one = {r.o: r.before for r in prefix_sums(df.where("k = 'a'"), "o", "v", None, 7).collect()}
    assert one == {o: b for (k, o), b in got.items() if k == "a"} and prefix_sums(df.limit(0), "o", "v").count() == 0
    paths = sorted({"/".join(rnd.choice("ab-.z") for _ in range(rnd.randrange(1, 6))) for _ in range(300)})
    ranked = {r.p: r["rank"] for r in rank_in_walk(spark.createDataFrame([(p, 1) for p in paths], "p string, rank2 int"), "p").collect()}
    assert [p for p, _ in sorted(ranked.items(), key=lambda x: x[1])] == sorted(paths, key=lambda p: p.split("/")) and sorted(ranked.values()) == list(range(1, len(paths) + 1))
    top = {(r.k, r.o) for r in top_within(df, "k", "o", 5, salts=3).collect()}
    assert top == {(k, o) for k in "abc" for o in sorted(p for q, p, _, _ in rows if q == k)[:5]}


def test_intervals_meet(spark):
    from echotrace.operators.intervals import meeting

    rnd = random.Random(8)
    span = lambda: (lambda a: (a, a + rnd.randrange(-2, 150)))(rnd.randrange(400))
    left = [(i, rnd.randrange(3), *span()) for i in range(200)] + [(900, 1, None, 5), (901, None, 1, 5)]
    right = [(rnd.randrange(3), *span()) for _ in range(12)] + [(1, 5, None)]
    l, r = spark.createDataFrame(left, "id int, f int, lo int, hi int"), spark.createDataFrame(right, "f int, lo int, hi int").withColumn("id", F.lit(1))
    fit = lambda x: None not in x[-3:] and x[-2] <= x[-1]
    for contained in (False, True):
        hit = lambda x, y: x[1] == y[0] and (y[1] <= x[2] and x[3] <= y[2] if contained else x[2] <= y[2] and y[1] <= x[3])  # noqa: B023,E731
        want = {x[0] for x in left if fit(x) and any(fit(y) and hit(x, y) for y in right)}
        assert {q.id for q in meeting(l, r, "f", contained=contained).collect()} == want
        assert {q.id for q in meeting(l, r, "f", "left_anti", contained=contained).collect()} == {x[0] for x in left} - want


def test_generated_files(spark):
    from echotrace.functions.generated import is_generated

    rows = [
        ("a.pb.go", "", True), ("A.G.CS", None, True), ("a.go", "package a\n// Code generated by x. DO NOT EDIT.", True), ("a.go", "// Generated by protoc\npackage a", True),
        ("a.go", "package a\n// generated by hand", False), ("a.go", "// compares files generated by two tools\npackage a", False), ("a.py", "#!/usr/bin/env python\n# This file was automatically generated\nx", True),
        ("a.c", "#include <a>\n// Generated by x", False), ("a.js", "/* one\n two */\n\n/* Auto-generated from y */ x", True), ("a.js", "x" * 2500, True), ("a.js", "x = 1\n" * 600 + "y" * 2100, False), (None, "x", False),
    ]
    got = [r.g for r in spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "i int, p string, t string").orderBy("i").select(is_generated(F.col("p"), F.col("t")).alias("g")).collect()]
    assert [bool(g) for g in got] == [w for _, _, w in rows]


def test_sql_functions(spark):
    from echotrace.functions.lexer import fnv64
    from echotrace.plans.detect import register_functions

    register_functions(spark)
    assert [r.text + r.orig for r in spark.sql("SELECT * FROM lex_source('a := 1 // c', 'go') ORDER BY pos").collect()] == ["a", ":=", "1"]
    assert spark.sql("SELECT fnv64('ab') AS x, fnv64(NULL) AS y").first()[:] == (f"{fnv64(b'ab'):016x}", None)
