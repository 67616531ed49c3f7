"""Detection of a whole scan: per-file thresholds by rules, one pass per threshold, and what is done with the clones afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.governance import SCAN, Rule, rule_globs
from ..functions.paths import glob_match, is_test
from ..session import cut_lineage
from .detect import MIN_LINES, dedup_overlapping, exact_clones
from .fuzzy import MAX_BUCKET, MAX_PAIRS, SIMILARITY, Completeness, fuzzy_detection


@dataclass(frozen=True)
class Settings:
    """What a scan detects, where no rule says otherwise."""

    min_tokens: int = 50
    similarity: float = SIMILARITY
    whole_file: bool = True
    min_clone_lines: int = MIN_LINES
    max_bucket: int = MAX_BUCKET
    max_pairs: int = MAX_PAIRS
    max_bytes: int = 0


def with_settings(files: DataFrame, rules: list[Rule], s: Settings) -> DataFrame:
    """Add rule, rule_index, own_tokens and floor: those of the first rule that matches `path`, else the scan's. Files that a rule skips are left out."""

    def pick(of, default) -> Column:
        out: Column | None = None
        for r in rules:
            hit = F.lit(False)
            for g in rule_globs(r):
                hit = hit | glob_match(F.col("path"), g)
            out = F.when(hit, F.lit(of(r))) if out is None else out.when(hit, F.lit(of(r)))
        return F.lit(default) if out is None else out.otherwise(F.lit(default))

    out = files.withColumn("skip", pick(lambda r: r.skip, False)).withColumn("rule", pick(lambda r: r.name, SCAN)).withColumn("rule_index", pick(lambda r: r.index, len(rules)))
    out = out.withColumn("own_tokens", pick(lambda r: r.min_tokens or s.min_tokens, s.min_tokens)).withColumn("floor", pick(lambda r: float(r.similarity or s.similarity), float(s.similarity)))
    return out.where(~F.col("skip")).drop("skip")


def detect_by_rules(files: DataFrame, s: Settings, in_scope: DataFrame | None = None) -> tuple[DataFrame, Completeness]:
    """Clones (key, clone_type, ..., instances, rule, rule_tokens) of files with own thresholds (with_settings), and how complete they are.

    One pass for each distinct threshold, over the files that allow it; it keeps the clones whose strictest file has that very threshold (of several
    such files the earliest rule counts), and type-3 ones that reach the highest floor of their files. The budget of pairs is that of all passes.
    """
    done, passes = Completeness(), []
    thresholds = sorted(r[0] for r in files.select("own_tokens").distinct().collect())  # one per rule at most
    of_file = files.select("file_id", "rule", "rule_index", "own_tokens", "floor")
    for t in thresholds:
        sub = files.where(F.col("own_tokens") <= t).withColumn("k", F.lit(t))
        c = cut_lineage(exact_clones(sub.select("file_id", "run_id", "path", "text", "k"), s.whole_file, in_scope).withColumn("similarity", F.lit(1.0)))
        floor = sub.agg(F.min("floor")).first()[0]
        left = s.max_pairs - done.evaluated
        if floor is not None and floor < 1.0 and not (s.max_pairs and left <= 0):
            near, how = fuzzy_detection(sub.select("file_id", "run_id", "path", "text", "k"), c, floor, s.max_bucket, left if s.max_pairs else 0, in_scope, s.max_bytes)
            done.add(how)
            c = c.unionByName(near.withColumn("clone", F.concat(F.lit("~"), "clone")))
        c = c.withColumn("key", F.concat(F.lit(f"{t}/"), "clone"))
        files_of = c.select("key", F.explode("instances").alias("i")).select("key", F.col("i.file_id").alias("file_id")).distinct().join(of_file, "file_id")
        judge = files_of.groupBy("key").agg(F.max("own_tokens").alias("rule_tokens"), F.max_by("rule", F.struct("own_tokens", -F.col("rule_index"))).alias("rule"), F.max("floor").alias("_floor"))
        kept = c.join(judge, "key").where((F.col("rule_tokens") == t) & ((F.col("clone_type") != "type-3") | (F.col("similarity") >= F.col("_floor"))))
        passes.append(cut_lineage(kept.drop("_floor")))
    if not passes:
        return exact_clones(files.withColumn("k", F.lit(s.min_tokens))).select("*", F.lit(1.0).alias("similarity"), F.lit("").alias("key"), F.lit(0).alias("rule_tokens"), F.lit("").alias("rule")).limit(0), done
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return (without_partial_copies(out) if len(passes) > 1 else out), done


def without_partial_copies(clones: DataFrame) -> DataFrame:
    """Drop a clone when another one with its hash has all its instances and more. Candidates share the first instance, so no pairs are made of all clones of a hash."""
    place = lambda x: F.concat_ws(":", x["path"], x["start_line"], x["end_line"])
    c = clones.select("key", "hash", F.array_distinct(F.transform("instances", place)).alias("at"))
    small = c.select(F.col("key").alias("small"), "hash", F.col("at").alias("of"), F.array_min("at").alias("p"))
    big = c.select(F.col("key").alias("big"), "hash", F.col("at"), F.explode("at").alias("p"))
    inside = small.join(big, ["hash", "p"]).where((F.size("of") < F.size("at")) & (F.size(F.array_except("of", "at")) == 0))
    return clones.join(inside.select(F.col("small").alias("key")).distinct(), "key", "left_anti")


def scan_clones(files: DataFrame, rules: list[Rule], s: Settings, in_scope: DataFrame | None = None) -> tuple[DataFrame, Completeness]:
    """All clones of a scan after overlaps and short ones are dropped, each instance with is_test and its lines of text (at most PREVIEW)."""
    from ..functions.report import PREVIEW_MD

    own = cut_lineage(with_settings(files, rules, s))
    found, done = detect_by_rules(own, s, in_scope)
    c = dedup_overlapping(cut_lineage(found), "key").where(F.col("line_count") >= s.min_clone_lines)
    # Texts are fetched for the first instance only: it is the one that reports show.
    head = c.select("key", F.col("instances")[0]["path"].alias("path"), F.col("instances")[0]["start_line"].alias("a"), F.col("instances")[0]["end_line"].alias("b"))
    n = F.least(F.col("b") - F.col("a") + 1, F.lit(PREVIEW_MD))
    lines = head.join(own.select("path", "text"), "path").select("key", F.slice(F.split("text", "\n", -1), F.col("a"), n).alias("lines"))
    tests = F.transform("instances", lambda x: is_test(x["path"]))
    return c.join(lines, "key", "left").withColumn("tests", tests), done
