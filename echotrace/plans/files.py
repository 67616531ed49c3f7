"""Choosing and measuring source files: the predicates of a scan over a table of (file_id, file_path, src_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.languages import BY_EXTENSION
from ..functions.paths import base_name, dir_name, extension, glob_match, in_pruned_dir, is_test, selected, slashed
from ..functions.generated import GENERATED_ENDINGS, HEAD, STRONG_MARKS, is_generated
from ..operators.skew import rank_in_walk
from ..session import table

#: Default limit of a file's size, and the length of the head that is searched for NUL bytes (fixed values).
MAX_FILE_SIZE, BINARY_HEAD = 5 * 1024 * 1024, 512
#: A file is minified when most of its bytes lie on lines this long and its mean line is that long (fixed values).
LONG_LINE, MEAN_LINE = 2000, 500


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file once: id, run, path with forward slashes, text."""
    return (
        table(spark, sf_dir, "tokenized_files")
        .select("file_id", "run_id", slashed(F.col("file_path")).alias("path"), "src_text", "lang")
        .groupBy("file_id").agg(*(F.min(c).alias(c) for c in ("run_id", "path", "src_text", "lang")))
    )


def line_count(text: Column) -> Column:
    """Line feeds, and one more if the text doesn't end with one; an empty text has no lines."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1)) - text.endswith("\n").cast("int"))


def is_binary(text: Column) -> Column:
    """A NUL among the first bytes."""
    return F.instr(F.substring(text, 1, BINARY_HEAD), "\x00") > 0


def is_minified(text: Column) -> Column:
    """More than half of the bytes on lines of LONG_LINE or more, and a mean line of MEAN_LINE or more."""
    sizes = F.transform(F.split(text, "\n", -1), lambda s: F.octet_length(s))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    far = F.aggregate(F.filter(sizes, lambda x: x >= LONG_LINE), F.lit(0), lambda a, x: a + x)
    return (far * 2 > total) & (total >= F.size(sizes) * MEAN_LINE)


def scan_line_count(spark, sf_dir):
    f = source_files(spark, sf_dir)
    return f.select("file_id", line_count(F.col("src_text")).alias("lines"), F.octet_length("src_text").alias("bytes"))


def scan_dir_prune(spark, sf_dir):
    f = source_files(spark, sf_dir)
    return f.where(~in_pruned_dir(F.col("path"))).select("file_id", "path")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(BY_EXTENSION.items()), "ext string, language string")


def scan_language(spark, sf_dir):
    """Language by extension: the dimension is a fixed 36 rows, so it is broadcast."""
    f = source_files(spark, sf_dir).withColumn("ext", extension(F.col("path")))
    return f.join(F.broadcast(languages(spark)), "ext", "left").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("src_text")).alias("bytes"))


def scan_language_filter(spark, sf_dir):
    return source_files(spark, sf_dir).where(F.lower("lang") == "typescript").select("file_id", "path")


def scan_glob_filter(spark, sf_dir):
    f = source_files(spark, sf_dir)
    keep = selected(F.col("path"), ["**/*.{go,py}", "c*.js"], ["*_test.*", "**/vendor/**", "[s-t]*.py"])
    return f.where(keep).select("file_id", "path")


def scan_size_filter(spark, sf_dir):
    """Size first: lengths are read beside the texts' rows, and rows over the limit never reach the shuffle that makes files distinct."""
    t = table(spark, sf_dir, "tokenized_files").select("file_id", F.octet_length("src_text").alias("bytes"))
    return t.where("bytes <= 2048").groupBy("file_id").agg(F.min("bytes").alias("bytes"))


def scan_binary_filter(spark, sf_dir):
    """Texts with a NUL among their first 512 characters; one is set into each text before its (doc_id mod 1024)th character, if it is that long."""
    at = (F.col("doc_id") % 1024).cast("int")
    planted = F.when(F.length("text") >= at, F.concat(F.substring("text", F.lit(1), at), F.lit("\x00"), F.expr("substring(text, cast(doc_id % 1024 AS int) + 1)"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", is_binary(planted).alias("is_binary"))


def scan_generated_filter(spark, sf_dir):
    """Whether each file is machine-written, and whether by its name or a strong mark alone."""
    f = source_files(spark, sf_dir)
    ending = F.lit(False)
    for e in GENERATED_ENDINGS:
        ending = ending | F.lower("path").endswith(e)
    strong = ending | F.substring("src_text", 1, HEAD).rlike("(?i)" + "|".join(STRONG_MARKS))
    return f.select("file_id", F.coalesce(strong, F.lit(False)).alias("plainly"), F.coalesce(is_generated(F.col("path"), F.col("src_text")), F.lit(False)).alias("generated"))


def scan_minified_filter(spark, sf_dir):
    return source_files(spark, sf_dir).select("file_id", is_minified(F.col("src_text")).alias("minified"))


def scan_walk_order(spark, sf_dir):
    """Position of each file in a directory walk: paths compared part by part, within a run."""
    f = source_files(spark, sf_dir)
    return rank_in_walk(f.select("run_id", "file_id", "path"), "path", "run_id", "file_id").select("run_id", "file_id", F.col("rank").cast("int").alias("walk_no"))


def scan_min_tokens(spark, sf_dir):
    """Per run: files, files with fewer tokens than the run's minimum, and files that could not be lexed."""
    k = table(spark, sf_dir, "detect_runs").groupBy("run_id").agg(F.coalesce(F.nullif(F.max("min_tokens"), F.lit(0)), F.lit(50)).alias("k"))
    f = table(spark, sf_dir, "tokenized_files").groupBy("run_id", "file_id").agg(F.max(F.when(F.col("tokens").isNotNull(), F.size("tokens"))).alias("n"))
    return f.join(k, "run_id").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("n") < F.col("k")).alias("below_min"), F.count_if(F.col("n").isNull()).alias("not_lexed")
    )


def file_classes(spark, sf_dir):
    f = source_files(spark, sf_dir)
    return f.select("file_id", base_name(F.col("path")).alias("base"), dir_name(F.col("path")).alias("dir"), extension(F.col("path")).alias("ext"), is_test(F.col("path")).alias("is_test"))


#: Rules as (name, globs): the first that matches a file holds (fixed example).
RULES = [("tests", ["**/test/**", "**/tests/**", "test/**", "tests/**", "*_test.*"]), ("api", ["api/**", "cmd/**"]), ("go", ["*.go"])]


def first_rule(path: Column, rules=RULES) -> Column:
    """Name of the first rule one of whose globs matches; null if none does."""
    c = F.lit(None).cast(T.StringType())
    for name, globs in reversed(rules):
        hit = F.lit(False)
        for g in globs:
            hit = hit | glob_match(path, g)
        c = F.when(hit, F.lit(name)).otherwise(c)
    return c


def rules_first_match(spark, sf_dir):
    f = source_files(spark, sf_dir)
    return f.groupBy(first_rule(F.col("path")).alias("rule")).agg(F.count(F.lit(1)).alias("files"))


def lex_token_kinds(spark, sf_dir):
    """Tokens per file by the kind that their first character tells."""
    t = table(spark, sf_dir, "tokenized_files").where("tokens is not null").groupBy("file_id").agg(F.first("tokens").alias("tokens"))
    c = F.col("t")
    kind = (
        F.when(c.rlike("^[A-Za-z_]"), "word").when(c.rlike("^[0-9]"), "number").when(c.rlike("^[\"'`]"), "string").otherwise("operator")
    )
    return t.select(F.explode("tokens").alias("t")).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_F = r"(SELECT file_id, min(run_id) AS run_id, min(regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '')) AS path, min(src_text) AS src_text, min(lang) AS lang FROM tokenized_files GROUP BY 1)"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
_TEST = rf"""(ends_with(lower({_BASE}), '_test.go') OR regexp_matches(lower({_BASE}), '\.(spec|test)\.') OR contains(lower(path), '__tests__/')
  OR (ends_with(lower({_BASE}), '.py') AND contains(lower(path), '/tests/')) OR contains(lower(path), 'src/test/')
  OR (ends_with(lower({_BASE}), '.rb') AND regexp_matches(lower(path), '(^|/)spec/')) OR contains(lower({_BASE}), 'test') OR contains(lower({_BASE}), 'spec'))"""
_PRUNED = "('vendor', 'node_modules', 'dist', 'build', 'target', '__pycache__', 'testdata')"

QUERIES = {
    f.__name__: f
    for f in (
        scan_line_count, scan_dir_prune, scan_language, scan_language_filter, scan_glob_filter, scan_size_filter, scan_binary_filter, scan_generated_filter,
        scan_minified_filter, scan_walk_order, scan_min_tokens, file_classes, rules_first_match, lex_token_kinds,
    )
}
# The comment that opens a file ends at the first line of code: lines are numbered, and those of block comments found by the opens and closes before them.
_GENERATED = f"""WITH f AS (SELECT file_id, min(regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '')) AS path, min(src_text) AS t FROM tokenized_files GROUP BY 1),
  l AS (SELECT file_id, unnest(string_split(substr(coalesce(t, ''), 1, {HEAD}), chr(10))) AS x, generate_subscripts(string_split(substr(coalesce(t, ''), 1, {HEAD}), chr(10)), 1) AS n FROM f),
  s AS (SELECT file_id, n, trim(x, ' ') AS x FROM l),
  o AS (SELECT *, starts_with(x, '/*') AS opens, contains(x, '*/') AS closes FROM s),
  w AS (SELECT *, coalesce(max(CASE WHEN opens AND NOT closes THEN n END) OVER b, 0) > coalesce(max(CASE WHEN closes THEN n END) OVER b, 0) AS within FROM o WINDOW b AS (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  k AS (SELECT *, within OR opens OR starts_with(x, '<!--') OR starts_with(x, '//') OR starts_with(x, '--') OR starts_with(x, '#') AND NOT regexp_matches(x, '^#(include|pragma|define|undef|if|else|elif|endif|import|error|line|\\[|!\\[)') AS comment FROM w),
  e AS (SELECT file_id, min(n) AS stop FROM k WHERE NOT comment AND x NOT IN ('', '<?php') GROUP BY 1),
  h AS (SELECT DISTINCT file_id FROM k LEFT JOIN e USING (file_id) WHERE comment AND n < coalesce(stop, 1000000)
    AND regexp_matches(regexp_replace(x, '^[/*#\\-<!; \\t]+', ''), '(?i)^(code generated|generated code|generated by|automatically generated|auto-?generated)\\b|this (file|code) (is|was) (auto(matically)?[- ]?)?generated|auto-?generated (file|code|by|from)')),
  m AS (SELECT file_id, list_sum(list_transform(list_filter(string_split(t, chr(10)), lambda y: strlen(y) >= 2000), lambda y: strlen(y))) * 2 > strlen(t) AND strlen(t) // len(string_split(t, chr(10))) >= 500 AS minified FROM f),
  p AS (SELECT f.file_id, coalesce({" OR ".join(f"ends_with(lower(path), '{e}')" for e in GENERATED_ENDINGS)} OR regexp_matches(substr(t, 1, {HEAD}), '(?i){"|".join(STRONG_MARKS)}'), false) AS plainly, h.file_id IS NOT NULL AS told, coalesce(minified, false) AS minified
    FROM f LEFT JOIN h USING (file_id) LEFT JOIN m USING (file_id))
  SELECT file_id, plainly, plainly OR told OR minified AS generated FROM p"""
ORACLES = {
    "scan_line_count": f"""SELECT file_id, CASE WHEN src_text = '' THEN 0 ELSE len(src_text) - len(replace(src_text, chr(10), '')) + CASE WHEN ends_with(src_text, chr(10)) THEN 0 ELSE 1 END END AS lines,
      strlen(src_text) AS bytes FROM {_F}""",
    "scan_dir_prune": f"""SELECT file_id, path FROM {_F} WHERE len(list_filter(string_split(path, '/')[:-2], lambda d: (starts_with(d, '.') AND d NOT IN ('.', '..')) OR d IN {_PRUNED})) = 0""",
    "scan_language": f"""SELECT language, count(*) AS files, CAST(sum(strlen(src_text)) AS BIGINT) AS bytes FROM (SELECT *, {_EXT} AS ext FROM {_F}) LEFT JOIN
      (VALUES {", ".join(f"('{e}', '{n}')" for e, n in sorted(BY_EXTENSION.items()))}) AS l(ext, language) USING (ext) GROUP BY 1""",
    "scan_language_filter": f"SELECT file_id, path FROM {_F} WHERE lower(lang) = 'typescript'",
    "scan_glob_filter": rf"""SELECT file_id, path FROM {_F} WHERE (regexp_matches(path, '^.*/[^/]*\.(go|py)$') OR regexp_matches({_BASE}, '^c.*\.js$'))
      AND NOT regexp_matches({_BASE}, '_test\.') AND NOT regexp_matches(path, '^.*/vendor/.*$') AND NOT regexp_matches({_BASE}, '^[s-t].*\.py$')""",
    "scan_size_filter": f"SELECT file_id, strlen(src_text) AS bytes FROM {_F} WHERE strlen(src_text) <= 2048",
    "scan_generated_filter": _GENERATED,
    "scan_binary_filter": """SELECT doc_id, coalesce(instr(substr(CASE WHEN length(text) >= doc_id % 1024 THEN substr(text, 1, doc_id % 1024) || chr(0) || substr(text, doc_id % 1024 + 1) ELSE text END, 1, 512), chr(0)) > 0, NULL) AS is_binary FROM documents""",
    "scan_minified_filter": f"""SELECT file_id, coalesce(list_sum(list_filter(s, lambda x: x >= {LONG_LINE})), 0) * 2 > coalesce(list_sum(s), 0) AND coalesce(list_sum(s), 0) >= len(s) * {MEAN_LINE} AS minified
      FROM (SELECT file_id, list_transform(string_split(src_text, chr(10)), lambda x: strlen(x)) AS s FROM {_F})""",
    "scan_walk_order": f"SELECT run_id, file_id, row_number() OVER (PARTITION BY run_id ORDER BY string_split(path, '/'), file_id) AS walk_no FROM {_F}",
    "scan_min_tokens": """WITH k AS (SELECT run_id, coalesce(nullif(max(min_tokens), 0), 50) AS k FROM detect_runs GROUP BY 1),
      f AS (SELECT run_id, file_id, max(len(tokens)) AS n FROM tokenized_files GROUP BY 1, 2)
      SELECT run_id, count(*) AS files, count(*) FILTER (n < k) AS below_min, count(*) FILTER (n IS NULL) AS not_lexed FROM f JOIN k USING (run_id) GROUP BY 1""",
    "file_classes": f"SELECT file_id, {_BASE} AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, {_EXT} AS ext, {_TEST} AS is_test FROM {_F}",
    "rules_first_match": rf"""SELECT CASE WHEN regexp_matches(path, '^(.*/)?tests?/.*$') AND (starts_with(path, 'test/') OR starts_with(path, 'tests/') OR contains(path, '/test/') OR contains(path, '/tests/')) OR regexp_matches({_BASE}, '_test\.') THEN 'tests'
      WHEN starts_with(path, 'api/') OR starts_with(path, 'cmd/') THEN 'api' WHEN ends_with({_BASE}, '.go') THEN 'go' END AS rule, count(*) AS files FROM {_F} GROUP BY 1""",
    "lex_token_kinds": r"""SELECT CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'word' WHEN regexp_matches(t, '^[0-9]') THEN 'number' WHEN regexp_matches(t, '^["''`]') THEN 'string' ELSE 'operator' END AS kind, count(*) AS n
      FROM (SELECT unnest(t) AS t FROM (SELECT file_id, any_value(tokens) AS t FROM tokenized_files WHERE tokens IS NOT NULL GROUP BY 1)) GROUP BY 1""",
}
