"""Clone tables after detection: measures, order, suppression, baselines, scopes and rules, as joins and aggregates.

Inputs are clones(clone_id, clone_hash, line_count, token_count, instances ...) and clone_instances; repeated rows of a
clone or an instance count once, null array elements are no instances, and nulls in keys match nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.paths import base_name, dir_name, glob_regex, is_test, slashed
from ..operators.intervals import covered_lines, meeting
from ..operators.skew import prefix_sums
from ..session import table


def clone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clone once, with its distinct, non-null instances in order."""
    c = table(spark, sf_dir, "clones").where("clone_id is not null")
    inst = F.array_sort(F.array_distinct(F.filter("instances", lambda x: x.isNotNull() & x["instance_id"].isNotNull())))
    return c.dropDuplicates(["clone_id"]).withColumn("instances", F.coalesce(inst, F.array().cast(c.schema["instances"].dataType))).withColumn("clone_type", F.lower("clone_type"))


def instance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clone_instances").where("instance_id is not null").dropDuplicates(["instance_id"])


def paths_of(c: Column) -> Column:
    """Paths of a clone's instances, with forward slashes; null paths are left out."""
    return F.transform(F.filter(c, lambda x: x["file_path"].isNotNull()), lambda x: F.regexp_replace(F.replace(x["file_path"], F.lit("\\"), F.lit("/")), r"^(\./)+", ""))


def clone_insights(spark, sf_dir):
    """Instances, saved lines (all but one copy), and how far apart the copies lie."""
    c = clone_rows(spark, sf_dir)
    p = paths_of(F.col("instances"))
    files, dirs = F.size(F.array_distinct(p)), F.size(F.array_distinct(F.transform(p, dir_name)))
    n = F.size("instances")
    scope = F.when(dirs > 1, "cross-dir").when(files > 1, "cross-file").otherwise("same-file")
    return c.select("clone_id", n.alias("n_instances"), F.when(n > 1, (n - 1) * F.col("line_count")).otherwise(0).alias("saved_lines"), scope.alias("scope"))


def total_saved(spark, sf_dir):
    c = clone_rows(spark, sf_dir).where(~F.coalesce("suppressed", F.lit(False)))
    n = F.size("instances")
    return c.agg(F.coalesce(F.sum(F.when(n > 1, (n - 1) * F.col("line_count")).otherwise(0)), F.lit(0)).alias("saved_lines"), F.count(F.lit(1)).alias("n_clones"))


def type_breakdown(spark, sf_dir):
    return clone_rows(spark, sf_dir).groupBy("clone_type").agg(F.count(F.lit(1)).alias("n"))


def impact_topk(spark, sf_dir):
    """The ten clones with the most to gain: lines times spare copies, then tokens, then hash (a top-k report)."""
    c = clone_rows(spark, sf_dir)
    impact = F.col("line_count") * F.greatest(F.size("instances") - 1, F.lit(1))
    return c.select("clone_id", impact.alias("impact"), "token_count", "clone_hash").orderBy(F.desc("impact"), F.desc("token_count"), "clone_hash").limit(10)


def dup_lines_per_file(spark, sf_dir):
    """Distinct duplicate lines per file, from the union of its instances' line ranges."""
    i = instance_rows(spark, sf_dir).where("start_line is not null and end_line >= start_line")
    return covered_lines(i.select("file_id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi")), "file_id").select("file_id", F.col("covered").alias("duplicate_lines"))


def duplication_pct(spark, sf_dir):
    """Per run: lines, duplicate lines, and the per cent to one decimal; a file's lines are the most that any report names."""
    d = dup_lines_per_file(spark, sf_dir)
    s = table(spark, sf_dir, "file_stats").groupBy("run_id", "file_id").agg(F.max("total_lines").alias("total"))
    g = s.join(d, "file_id", "left").groupBy("run_id").agg(F.sum("total").alias("total_lines"), F.coalesce(F.sum("duplicate_lines"), F.lit(0)).alias("duplicate_lines"))
    return g.withColumn("pct", F.round(F.col("duplicate_lines") * 1000 / F.greatest("total_lines", F.lit(1)), 0).__truediv__(10))


def hotspots_topk(spark, sf_dir):
    """The ten most duplicated files (a top-k report)."""
    d = dup_lines_per_file(spark, sf_dir)
    s = table(spark, sf_dir, "file_stats").groupBy("file_id").agg(F.max("total_lines").alias("total"))
    pct = F.round(F.col("duplicate_lines") * 1000 / F.greatest("total", F.lit(1)), 0).__truediv__(10)
    return s.join(d, "file_id").select("file_id", "duplicate_lines", pct.alias("pct")).orderBy(F.desc("pct"), "file_id").limit(10)


def testprod_span(spark, sf_dir):
    """Clones with copies both in test and in production files."""
    c = clone_rows(spark, sf_dir).select("clone_id", F.explode(paths_of(F.col("instances"))).alias("path"))
    g = c.groupBy("clone_id").agg(F.bool_or(is_test(F.col("path"))).alias("t"), F.bool_or(~is_test(F.col("path"))).alias("p"))
    return g.where("t and p").select("clone_id")


#: Suppression rules: hash prefixes, globs and file ranges (fixed example).
PREFIXES, GLOB, RANGES = ("0", "9f", "a1"), "**/vendor/**", [("go", 1, 12)]


def suppress_hash_prefix(spark, sf_dir):
    rules = spark.createDataFrame([(p,) for p in PREFIXES], "rule string")
    c = clone_rows(spark, sf_dir)
    return c.join(F.broadcast(rules), F.startswith(F.lower("clone_hash"), F.col("rule")), "left_semi").select("clone_id")


def suppress_glob(spark, sf_dir):
    r = glob_regex(GLOB)
    return clone_rows(spark, sf_dir).where(F.exists(paths_of(F.col("instances")), lambda p: p.rlike(r) | base_name(p).rlike(r))).select("clone_id")


def suppress_range(spark, sf_dir):
    """Clones with an instance that overlaps a suppressed line range of files with a suffix."""
    rules = F.broadcast(spark.createDataFrame(RANGES, "suffix string, lo int, hi int"))
    c = clone_rows(spark, sf_dir).select("clone_id", F.explode("instances").alias("i"))
    hit = F.endswith(F.col("i.file_path"), F.col("suffix")) & (F.col("i.start_line") <= F.col("hi")) & (F.col("lo") <= F.col("i.end_line"))
    return c.join(rules, hit, "left_semi").select("clone_id").distinct()


def staged_semi(spark, sf_dir):
    """Clones with an instance in a staged file: staged are the test files' siblings, those with an even id here."""
    staged = instance_rows(spark, sf_dir).where("file_commits > 20").select("instance_id")
    c = clone_rows(spark, sf_dir).select("clone_id", F.explode("instances.instance_id").alias("instance_id"))
    return c.join(staged, "instance_id", "left_semi").select("clone_id").distinct()


def since_overlap(spark, sf_dir):
    """Clones that touch changed lines: an equi-join on file and bucket of lines, then the interval condition."""
    changed = table(spark, sf_dir, "blocks").select("file_id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    i = instance_rows(spark, sf_dir).select("instance_id", "file_id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    touched = meeting(i, changed, "file_id").select("instance_id")
    c = clone_rows(spark, sf_dir).select("clone_id", F.explode("instances.instance_id").alias("instance_id"))
    return c.join(touched, "instance_id", "left_semi").select("clone_id").distinct()


def baseline_write(spark, sf_dir):
    """Fingerprints of the clones that aren't suppressed, with the most instances of each."""
    c = clone_rows(spark, sf_dir).where(~F.coalesce("suppressed", F.lit(False)) & F.col("clone_hash").isNotNull())
    return c.groupBy("clone_hash").agg(F.max(F.size("instances")).alias("n"))


def baseline_apply(spark, sf_dir):
    """Known, grown and new clones against a baseline: the clones of runs up to 10 with one instance less than every fourth has."""
    c = clone_rows(spark, sf_dir)
    base = c.where("run_id <= 10").groupBy(F.col("clone_hash").alias("h")).agg(F.max(F.size("instances") - (F.col("clone_id") % 4 == 0).cast("int")).alias("cnt"))
    j = c.join(base, F.col("clone_hash") == F.col("h"), "left")
    state = F.when(F.col("cnt").isNull(), "new").when(F.size("instances") <= F.col("cnt"), "known").otherwise("grown")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def churn_order(spark, sf_dir):
    """Clones by the commits of their instances' files, most churned first; ties by line count, then id."""
    i = instance_rows(spark, sf_dir).select("instance_id", F.coalesce("file_commits", F.lit(0)).alias("commits"))
    c = clone_rows(spark, sf_dir).select("clone_id", "line_count", F.explode_outer("instances.instance_id").alias("instance_id"))
    s = c.join(i, "instance_id", "left").groupBy("clone_id", "line_count").agg(F.coalesce(F.sum("commits"), F.lit(0)).alias("churn"))
    # Distinct counts of commits are few: their sizes give where each begins, and ranks within one follow.
    before = Window.orderBy(F.desc("churn")).rowsBetween(Window.unboundedPreceding, -1)
    starts = s.groupBy("churn").agg(F.count(F.lit(1)).alias("n")).select("churn", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("churn").orderBy(F.desc("line_count"), "clone_id"))
    return s.join(F.broadcast(starts), "churn").select("clone_id", "churn", (within + F.col("start")).cast("int").alias("rank"))


def with_partial_copies(c: DataFrame) -> DataFrame:
    """Clones and, of every one with three instances or more, a copy without its last one, as a stricter pass would have found it (clone_id negative)."""
    part = c.where(F.size("instances") > 2).withColumn("clone_id", -F.col("clone_id") - 1).withColumn("instances", F.expr("slice(instances, 1, size(instances) - 1)"))
    return c.unionByName(part)


def partial_copies(spark, sf_dir):
    """Clones whose instances are a strict subset of those of a clone with the same hash; the two meet at the smaller one's first instance."""
    c = with_partial_copies(clone_rows(spark, sf_dir).where("clone_hash is not null").select("clone_id", "clone_hash", "instances"))
    c = c.select("clone_id", "clone_hash", F.col("instances.instance_id").alias("ids"))
    small = c.where(F.size("ids") > 0).select("clone_id", "clone_hash", "ids", F.array_min("ids").alias("at"))
    more = c.select(F.col("clone_hash").alias("h"), F.col("ids").alias("more"), F.explode("ids").alias("id"))
    inside = (F.size(F.array_except("ids", "more")) == 0) & (F.size("ids") < F.size("more"))
    return small.join(more, (F.col("clone_hash") == F.col("h")) & (F.col("at") == F.col("id")) & inside, "left_semi").select("clone_id")


def exact_cover_antijoin(spark, sf_dir):
    """Blocks whose lines no single instance of their file contains."""
    b = table(spark, sf_dir, "blocks").dropDuplicates(["block_id"]).select("block_id", "file_id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    i = instance_rows(spark, sf_dir).select("file_id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    return meeting(b, i, "file_id", "left_anti", contained=True).select("block_id")


def mini_hash_index(spark, sf_dir):
    """Postings of the inverted index by their length: how many values stand in how many blocks."""
    b = table(spark, sf_dir, "blocks").dropDuplicates(["block_id"])
    e = b.select("run_id", F.explode(F.array_distinct("mini")).alias("h")).where("h <> 0")
    return e.groupBy("run_id", "h").agg(F.count(F.lit(1)).alias("blocks")).groupBy("blocks").agg(F.count(F.lit(1)).alias("n_values"))


def run_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, max_bucket, max_pairs), one row a run; null and 0 stand for the defaults."""
    of = lambda c, d: F.coalesce(F.nullif(F.max(c), F.lit(0)), F.lit(d)).alias(c)
    return table(spark, sf_dir, "detect_runs").where("run_id is not null").groupBy("run_id").agg(of("max_bucket", 500), of("max_pairs", 50_000_000))


def bucket_truncation(spark, sf_dir):
    """Per run the postings that its max_bucket keeps of each value, and how many values it cuts; what is kept is a count, so none is numbered."""
    b = table(spark, sf_dir, "blocks").dropDuplicates(["block_id"])
    n = b.select("run_id", "block_id", F.explode(F.array_distinct("mini")).alias("h")).where("h <> 0").groupBy("run_id", "h").agg(F.count(F.lit(1)).alias("n"))
    r = n.join(run_options(spark, sf_dir), "run_id")
    return r.groupBy("run_id").agg(F.sum(F.least("n", "max_bucket")).alias("kept"), F.count_if(F.col("n") > F.col("max_bucket")).alias("truncated_values"))


def pair_budget_cut(spark, sf_dir):
    """Matches of a run in order of their first end, while those of earlier ends stay within its max_pairs: ends and pairs kept."""
    m = table(spark, sf_dir, "fuzzy_matches").where("a_idx <> b_idx").select("run_id", F.least("a_idx", "b_idx").alias("a"), F.greatest("a_idx", "b_idx").alias("b")).distinct()
    c = prefix_sums(m.groupBy("run_id", "a").agg(F.count(F.lit(1)).alias("cnt")), "a", "cnt", "run_id").join(run_options(spark, sf_dir), "run_id")
    return c.where("before <= max_pairs").groupBy("run_id").agg(F.count(F.lit(1)).alias("ends"), F.sum("cnt").alias("pairs"))


def match_threshold(spark, sf_dir):
    """Matches of each run at or above its similarity and below 1, both directions and repetitions of a match counted once."""
    t = table(spark, sf_dir, "detect_runs").groupBy("run_id").agg(F.coalesce(F.nullif(F.max("min_similarity"), F.lit(0.0)), F.lit(0.7)).alias("t"))
    m = table(spark, sf_dir, "fuzzy_matches").where("a_idx <> b_idx and similarity is not null")
    m = m.groupBy("run_id", F.least("a_idx", "b_idx").alias("a"), F.greatest("a_idx", "b_idx").alias("b")).agg(F.max("similarity").alias("s"))
    return m.join(t, "run_id").where("s >= t and s < 1.0").groupBy("run_id").agg(F.count(F.lit(1)).alias("matches"))


def diff_hunks(spark, sf_dir):
    """Changed ranges from unified diff headers that are built from the blocks' lines."""
    b = table(spark, sf_dir, "blocks").dropDuplicates(["block_id"]).where("start_line is not null and end_line is not null")
    n = F.col("end_line") - F.col("start_line") + 1
    head = F.concat(F.lit("diff --git a/x b/x\n@@ -1,3 +"), F.col("start_line"), F.when(n == 1, F.lit("")).otherwise(F.concat(F.lit(","), n)), F.lit(" @@ ctx\n+new\n@@ -9 +0,0 @@\n"))
    return hunk_ranges(b.select("block_id", head.alias("diff")), "block_id")


#: Rules of the queries below: name, glob and least tokens; the first that matches a path holds, else the scan's own 50 (fixed example).
THRESHOLDS = (("tests", "**/test*/**", 25), ("services", "services/**", 70), ("vendored", "**/vendor/**", 40))


def own_threshold(path: Column) -> tuple[Column, Column, Column]:
    """Name, place and least tokens of the first of THRESHOLDS that matches a path."""
    name, index, tokens = F.lit("scan"), F.lit(len(THRESHOLDS)), F.lit(50)
    for n, (rule, glob, least) in reversed(list(enumerate(THRESHOLDS))):
        hit = F.coalesce(path.rlike(glob_regex(glob)), F.lit(False))
        name, index, tokens = (F.when(hit, F.lit(v)).otherwise(c) for v, c in ((rule, name), (n, index), (least, tokens)))
    return name, index, tokens


def rules_judge(spark, sf_dir):
    """The rule that judges each clone: of its files' the one with the most tokens, on ties the earliest."""
    i = clone_rows(spark, sf_dir).select("clone_id", F.explode(paths_of(F.col("instances"))).alias("path"))
    name, index, tokens = own_threshold(F.col("path"))
    j = i.select("clone_id", name.alias("rule"), index.alias("n"), tokens.alias("t"))
    return j.groupBy("clone_id").agg(F.max_by("rule", F.struct("t", -F.col("n"))).alias("rule"), F.max("t").alias("min_tokens"))


def threshold_passes(spark, sf_dir):
    """The passes of a scan with THRESHOLDS over each run's files: the thresholds that occur, in order, and how many files allow each."""
    f = table(spark, sf_dir, "tokenized_files").groupBy("file_id").agg(F.min("run_id").alias("run_id"), F.min(slashed(F.col("file_path"))).alias("path"))
    own = f.select("run_id", own_threshold(F.col("path"))[2].alias("t")).groupBy("run_id", "t").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("run_id").orderBy("t")  # a handful of thresholds a run
    return own.select("run_id", F.col("t").alias("threshold"), F.row_number().over(up_to).alias("pass_no"), F.sum("n").over(up_to.rowsBetween(Window.unboundedPreceding, 0)).alias("files"))


def function_names(spark, sf_dir):
    """The functions of each clone's instances, each once, in the order of instances; clones without any are left out."""
    c = clone_rows(spark, sf_dir).select("clone_id", F.posexplode("instances.instance_id").alias("no", "instance_id"))
    named = c.join(instance_rows(spark, sf_dir).where("func_name is not null").select("instance_id", "func_name"), "instance_id")
    first = named.groupBy("clone_id", "func_name").agg(F.min("no").alias("no"))
    # A clone's list of names is what its report shows.
    return first.groupBy("clone_id").agg(F.array_sort(F.collect_list(F.struct("no", "func_name"))).alias("l")).select("clone_id", F.array_join("l.func_name", ",").alias("functions"))


def preview_lines(spark, sf_dir):
    """A hash of the lines [start, end] of each instance's file: texts are cut to one row a file before they meet the instances, and only hashes come out."""
    texts = table(spark, sf_dir, "tokenized_files").groupBy("file_id").agg(F.min("src_text").alias("text"))
    i = instance_rows(spark, sf_dir).where("start_line >= 1 and end_line >= start_line").select("instance_id", "file_id", "start_line", "end_line")
    lines = F.slice(F.split("text", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return i.join(texts, "file_id").where("text is not null").select("instance_id", F.md5(F.array_join(lines, "\n")).alias("lines"))


def path_fingerprints(spark, sf_dir):
    """FNV-1a of each file's path, as fingerprints are made."""
    from ..functions.lexer import fnv64

    @F.pandas_udf("string")
    def stamp(paths: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else f"{fnv64(p.encode('utf-8')):016x}" for p in paths], dtype=object)

    f = table(spark, sf_dir, "tokenized_files").groupBy("file_id").agg(F.min("file_path").alias("path"))
    return f.select("file_id", stamp("path").alias("fnv"))


def hunk_ranges(diffs: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi) of each hunk in a column `diff`: +s,c is s..s+c-1, a missing count is 1, a count of 0 changes nothing."""
    pat = F.lit(r"(?m)^@@[^\n]*? \+(\d+)(?:,(\d+))?")
    z = F.arrays_zip(F.regexp_extract_all("diff", pat, F.lit(1)).alias("s"), F.regexp_extract_all("diff", pat, F.lit(2)).alias("c"))
    h = diffs.select(key, F.explode(z).alias("z")).select(key, F.col("z.s").cast("int").alias("lo"), F.when(F.col("z.c") == "", 1).otherwise(F.expr("try_cast(z.c as int)")).alias("c"))
    return h.where("c > 0").select(key, "lo", (F.col("lo") + F.col("c") - 1).alias("hi"))


_C = """c0 AS (SELECT DISTINCT ON (clone_id) * REPLACE (lower(clone_type) AS clone_type, list_sort(list_distinct(list_filter(coalesce(instances, []), lambda x: x IS NOT NULL AND x.instance_id IS NOT NULL))) AS instances) FROM clones WHERE clone_id IS NOT NULL),
  i0 AS (SELECT DISTINCT ON (instance_id) * FROM clone_instances WHERE instance_id IS NOT NULL),
  x AS (SELECT clone_id, line_count, unnest(instances) AS i FROM c0),
  p AS (SELECT clone_id, i, regexp_replace(replace(i.file_path, '\\', '/'), '^(\\./)+', '') AS path FROM x WHERE i.file_path IS NOT NULL)"""
_D = """l AS (SELECT file_id, count(DISTINCT n) AS duplicate_lines FROM (SELECT file_id, unnest(range(start_line, end_line + 1)) AS n FROM clone_instances WHERE instance_id IS NOT NULL AND start_line IS NOT NULL AND end_line >= start_line) GROUP BY 1),
  s AS (SELECT run_id, file_id, max(total_lines) AS total FROM file_stats GROUP BY 1, 2)"""
_B = "b0 AS (SELECT DISTINCT ON (block_id) * FROM blocks)"
_N = "len(instances)"


def _test_sql() -> str:
    from .files import _TEST

    return _TEST


# The globs of THRESHOLDS as regular expressions of SQL.
_RULE_SQL = """CASE WHEN regexp_matches(path, '^.*/test[^/]*/.*$') THEN {0} WHEN regexp_matches(path, '^services/.*$') THEN {1} WHEN regexp_matches(path, '^.*/vendor/.*$') THEN {2} ELSE {3} END"""


_FUNCS = (
    clone_insights, total_saved, type_breakdown, impact_topk, dup_lines_per_file, duplication_pct, hotspots_topk, testprod_span, suppress_hash_prefix, suppress_glob,
    suppress_range, staged_semi, since_overlap, baseline_write, baseline_apply, churn_order, partial_copies, exact_cover_antijoin, mini_hash_index, bucket_truncation,
    pair_budget_cut, match_threshold, diff_hunks, rules_judge, threshold_passes, function_names, preview_lines, path_fingerprints,
)
QUERIES = {f.__name__: f for f in _FUNCS}
ORACLES = {
    "clone_insights": f"""WITH {_C}, q AS (SELECT clone_id, count(DISTINCT path) AS f, count(DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END) AS d FROM p GROUP BY 1)
      SELECT clone_id, CAST({_N} AS INTEGER) AS n_instances, CASE WHEN {_N} > 1 THEN CAST(({_N} - 1) * line_count AS INTEGER) ELSE 0 END AS saved_lines,
      CASE WHEN d > 1 THEN 'cross-dir' WHEN f > 1 THEN 'cross-file' ELSE 'same-file' END AS scope FROM c0 LEFT JOIN q USING (clone_id)""",
    "total_saved": f"WITH {_C} SELECT CAST(coalesce(sum(CASE WHEN {_N} > 1 THEN ({_N} - 1) * line_count ELSE 0 END), 0) AS BIGINT) AS saved_lines, count(*) AS n_clones FROM c0 WHERE NOT coalesce(suppressed, false)",
    "type_breakdown": f"WITH {_C} SELECT clone_type, count(*) AS n FROM c0 GROUP BY 1",
    "impact_topk": f"WITH {_C} SELECT clone_id, CAST(line_count * greatest({_N} - 1, 1) AS INTEGER) AS impact, token_count, clone_hash FROM c0 ORDER BY impact DESC, token_count DESC, clone_hash LIMIT 10",
    "dup_lines_per_file": f"WITH {_D} SELECT * FROM l",
    "duplication_pct": f"""WITH {_D}, g AS (SELECT run_id, CAST(sum(total) AS BIGINT) AS total_lines, CAST(coalesce(sum(duplicate_lines), 0) AS BIGINT) AS duplicate_lines FROM s LEFT JOIN l USING (file_id) GROUP BY 1)
      SELECT *, round(duplicate_lines * 1000 / greatest(total_lines, 1), 0) / 10 AS pct FROM g""",
    "hotspots_topk": f"WITH {_D}, t AS (SELECT file_id, max(total) AS total FROM s GROUP BY 1) SELECT file_id, duplicate_lines, round(duplicate_lines * 1000 / greatest(total, 1), 0) / 10 AS pct FROM t JOIN l USING (file_id) ORDER BY pct DESC, file_id LIMIT 10",
    "testprod_span": f"WITH {_C}, t AS (SELECT clone_id, {_test_sql()} AS is_test FROM p) SELECT clone_id FROM t GROUP BY 1 HAVING bool_or(is_test) AND bool_or(NOT is_test)",
    "suppress_hash_prefix": f"WITH {_C} SELECT clone_id FROM c0 WHERE " + " OR ".join(f"starts_with(lower(clone_hash), '{p}')" for p in PREFIXES),
    "suppress_glob": f"WITH {_C} SELECT DISTINCT clone_id FROM p WHERE contains(path, '/vendor/')",
    "suppress_range": f"WITH {_C} SELECT DISTINCT clone_id FROM x WHERE ends_with(i.file_path, 'go') AND i.start_line <= 12 AND 1 <= i.end_line",
    "staged_semi": f"WITH {_C} SELECT DISTINCT clone_id FROM x WHERE i.instance_id IN (SELECT instance_id FROM i0 WHERE file_commits > 20)",
    "since_overlap": f"""WITH {_C} SELECT DISTINCT clone_id FROM x WHERE i.instance_id IN (SELECT instance_id FROM i0 JOIN blocks b ON i0.file_id = b.file_id AND i0.start_line <= b.end_line AND b.start_line <= i0.end_line)""",
    "baseline_write": f"WITH {_C} SELECT clone_hash, CAST(max({_N}) AS INTEGER) AS n FROM c0 WHERE NOT coalesce(suppressed, false) AND clone_hash IS NOT NULL GROUP BY 1",
    "baseline_apply": f"""WITH {_C}, b AS (SELECT clone_hash, max({_N} - CASE WHEN clone_id % 4 = 0 THEN 1 ELSE 0 END) AS cnt FROM c0 WHERE run_id <= 10 GROUP BY 1)
      SELECT CASE WHEN cnt IS NULL THEN 'new' WHEN {_N} <= cnt THEN 'known' ELSE 'grown' END AS state, count(*) AS n FROM c0 LEFT JOIN b USING (clone_hash) GROUP BY 1""",
    "churn_order": f"""WITH {_C}, t AS (SELECT clone_id, c0.line_count, CAST(coalesce(sum(coalesce(file_commits, 0)), 0) AS BIGINT) AS churn FROM c0 LEFT JOIN x USING (clone_id) LEFT JOIN i0 ON i0.instance_id = x.i.instance_id GROUP BY 1, 2)
      SELECT clone_id, churn, row_number() OVER (ORDER BY churn DESC, line_count DESC, clone_id) AS rank FROM t""",
    "partial_copies": f"""WITH {_C}, k0 AS (SELECT clone_id, clone_hash, list_transform(instances, lambda x: x.instance_id) AS ids FROM c0 WHERE clone_hash IS NOT NULL),
      k AS (SELECT * FROM k0 UNION ALL SELECT -clone_id - 1, clone_hash, ids[1 : len(ids) - 1] FROM k0 WHERE len(ids) > 2)
      SELECT DISTINCT a.clone_id FROM k a JOIN k b USING (clone_hash) WHERE list_has_all(b.ids, a.ids) AND len(a.ids) < len(b.ids) AND len(a.ids) > 0""",
    "exact_cover_antijoin": f"WITH {_C}, {_B} SELECT block_id FROM b0 WHERE NOT EXISTS (SELECT 1 FROM i0 WHERE i0.file_id = b0.file_id AND b0.start_line >= i0.start_line AND b0.end_line <= i0.end_line)",
    "mini_hash_index": f"WITH {_B}, e AS (SELECT DISTINCT run_id, block_id, unnest(mini) AS h FROM b0) SELECT blocks, count(*) AS n_values FROM (SELECT run_id, h, count(*) AS blocks FROM e WHERE h <> 0 GROUP BY 1, 2) GROUP BY 1",
    "bucket_truncation": f"""WITH {_B}, o AS (SELECT run_id, coalesce(nullif(max(max_bucket), 0), 500) AS cap FROM detect_runs GROUP BY 1), e AS (SELECT DISTINCT run_id, block_id, unnest(mini) AS h FROM b0),
      r AS (SELECT run_id, h, cap, row_number() OVER (PARTITION BY run_id, h ORDER BY block_id) AS rn FROM e JOIN o USING (run_id) WHERE h <> 0)
      SELECT run_id, count(*) FILTER (rn <= cap) AS kept, count(*) FILTER (rn = cap + 1) AS truncated_values FROM r GROUP BY 1""",
    "pair_budget_cut": """WITH m AS (SELECT DISTINCT run_id, least(a_idx, b_idx) AS a, greatest(a_idx, b_idx) AS b FROM fuzzy_matches WHERE a_idx <> b_idx), c AS (SELECT run_id, a, count(*) AS cnt FROM m GROUP BY 1, 2),
      o AS (SELECT run_id, coalesce(nullif(max(max_pairs), 0), 50000000) AS cap FROM detect_runs GROUP BY 1),
      w AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY run_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
      SELECT run_id, count(*) AS ends, CAST(sum(cnt) AS BIGINT) AS pairs FROM w JOIN o USING (run_id) WHERE before <= cap GROUP BY 1""",
    "match_threshold": """WITH t AS (SELECT run_id, coalesce(nullif(max(min_similarity), 0), 0.7) AS t FROM detect_runs GROUP BY 1),
      m AS (SELECT run_id, least(a_idx, b_idx) AS a, greatest(a_idx, b_idx) AS b, max(similarity) AS s FROM fuzzy_matches WHERE a_idx <> b_idx AND similarity IS NOT NULL GROUP BY 1, 2, 3)
      SELECT run_id, count(*) AS matches FROM m JOIN t USING (run_id) WHERE s >= t AND s < 1.0 GROUP BY 1""",
    "rules_judge": f"""WITH {_C}, j AS (SELECT clone_id, {_RULE_SQL.format("'tests'", "'services'", "'vendored'", "'scan'")} AS rule, {_RULE_SQL.format(0, 1, 2, 3)} AS n, {_RULE_SQL.format(25, 70, 40, 50)} AS t FROM p)
      SELECT clone_id, arg_max(rule, t * 10 - n) AS rule, CAST(max(t) AS INTEGER) AS min_tokens FROM j GROUP BY 1""",
    "threshold_passes": f"""WITH f AS (SELECT file_id, min(run_id) AS run_id, min(regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '')) AS path FROM tokenized_files GROUP BY 1),
      o AS (SELECT run_id, CASE WHEN path IS NULL THEN 50 ELSE {_RULE_SQL.format(25, 70, 40, 50)} END AS t, count(*) AS n FROM f GROUP BY 1, 2)
      SELECT run_id, CAST(t AS INTEGER) AS threshold, CAST(row_number() OVER (PARTITION BY run_id ORDER BY t) AS INTEGER) AS pass_no, CAST(sum(n) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS files FROM o""",
    "function_names": f"""WITH {_C}, n AS (SELECT clone_id, unnest(instances) AS i, generate_subscripts(instances, 1) AS no FROM c0), f AS (SELECT clone_id, func_name, min(no) AS no FROM n JOIN i0 ON i0.instance_id = n.i.instance_id WHERE func_name IS NOT NULL GROUP BY 1, 2)
      SELECT clone_id, string_agg(func_name, ',' ORDER BY no) AS functions FROM f GROUP BY 1""",
    "preview_lines": f"""WITH {_C}, t AS (SELECT file_id, min(src_text) AS text FROM tokenized_files GROUP BY 1)
      SELECT instance_id, md5(array_to_string(list_slice(string_split(text, chr(10)), start_line, end_line), chr(10))) AS lines FROM i0 JOIN t USING (file_id) WHERE text IS NOT NULL AND start_line >= 1 AND end_line >= start_line""",
    "path_fingerprints": """SELECT file_id, CASE WHEN path IS NOT NULL THEN lpad(lower(to_hex(CAST(list_reduce(list_transform(range(length(hex(encode(path))) // 2), lambda k: CAST(CAST('0x' || substr(hex(encode(path)), 2 * k + 1, 2) AS INTEGER) AS HUGEINT)),
      lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS UBIGINT))), 16, '0') END AS fnv FROM (SELECT file_id, min(file_path) AS path FROM tokenized_files GROUP BY 1)""",
    "diff_hunks": f"WITH {_B} SELECT block_id, start_line AS lo, end_line AS hi FROM b0 WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND end_line >= start_line",
}
