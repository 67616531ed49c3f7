"""Command line: scan a source tree and report its copies. Exit code 0 clean, 1 findings, 2 error."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .functions import config as C
from .functions import governance as G
from .functions.report import FORMATS, render

#: Defaults of the options that a configuration file may set (fixed values).
DEFAULTS = {"path": ".", "min_tokens": 50, "language": "", "top": 10, "baseline": "", "similarity": 0.70, "exclude": [], "include": []}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echotrace")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", aliases=["s"])
    a = s.add_argument
    a("-p", "--path", default=None)
    a("-t", "--min-tokens", type=int, default=None)
    a("-l", "--min-lines", type=int, default=0, help="older way to say min-tokens, ten tokens a line")
    a("-f", "--format", default="text", choices=list(FORMATS))
    a("-o", "--output", default="")
    a("-v", "--verbose", action="store_true", help="show all clones, and say what is done")
    a("-q", "--quiet", action="store_true", help="say nothing but warnings")
    a("-e", "--exclude", action="append", default=None)
    a("-i", "--include", action="append", default=None)
    a("-L", "--language", default=None)
    a("--similarity", type=float, default=None, help="1 leaves out type-3 clones")
    a("--max-bucket", type=int, default=5000, help="0 compares all; otherwise the report says when it cut")
    a("--max-pairs", type=int, default=50_000_000)
    a("--max-memory", default="auto", help="most that the index of type-3 detection may take, e.g. 2G; auto is no limit, as it spills")
    a("--scope", choices=["file", "function"], default="file")
    a("--min-clone-lines", type=int, default=5)
    a("--max-file-size", type=int, default=5 * 1024 * 1024)
    a("--max-files", type=int, default=0)
    a("--scan-generated", action="store_true")
    a("--top", type=int, default=None)
    a("--since", default="")
    a("--staged", action="store_true")
    a("--git-churn", action="store_true")
    a("--churn-days", type=int, default=90)
    a("-c", "--config", default="")
    a("--no-rules", action="store_true")
    a("--ignore-file", default="")
    a("--show-suppressed", action="store_true")
    a("--baseline", default=None)
    a("--write-baseline", default="")
    a("--min-duplication", type=float, default=0.0)
    a("--dead-code", action="store_true")
    a("--exit-zero", action="store_true")
    i = sub.add_parser("init", help="write a starter configuration")
    i.add_argument("--force", action="store_true")
    sub.add_parser("version")
    return p


def settle(o: argparse.Namespace) -> argparse.Namespace:
    """Options with what the command line left open taken from the configuration file, then from the defaults; `rules` are checked."""
    path = o.config or C.find_upwards(".")
    if o.config and not Path(o.config).is_file():
        raise ValueError(f"no such file: {o.config}")
    conf = C.load_config(path)
    if o.min_tokens is None and o.min_lines:
        o.min_tokens = o.min_lines * 10
    for k, default in DEFAULTS.items():
        if getattr(o, k) in (None, []):
            setattr(o, k, conf["scan"].get(k.replace("_", "-")) or default)
    try:
        o.rules = [] if o.no_rules else G.parse_rules(conf["rules"], conf["rules_line"])
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e
    if o.min_tokens <= 0:
        raise ValueError("--min-tokens must be greater than 0")
    if not 0.5 <= o.similarity <= 1:
        raise ValueError("--similarity must be between 0.50 and 1.00")
    return o


def scan(spark, o) -> dict:
    """The report of one scan."""
    from pyspark.sql import functions as F

    from .operators.intervals import covered_lines
    from .plans.deadcode import dead_functions, text_words
    from .plans.files import line_count
    from .plans.scan import Settings, scan_clones
    from .session import cut_lineage
    from .sources.tree import read_tree

    say = (lambda *x: print(*x, file=sys.stderr)) if o.verbose and not o.quiet else lambda *x: None
    root = str(Path(o.path).resolve())
    every = read_tree(spark, root, o.include, o.exclude, o.language, o.max_file_size, generated=True)
    all_files = cut_lineage(every)
    files = all_files if o.scan_generated else all_files.where(~F.col("generated"))
    total_files, n = all_files.count(), files.count()
    say(f"{n} files of {total_files}")
    if o.max_files and n > o.max_files:
        raise ValueError(f"{n} files are more than --max-files {o.max_files}")
    settings = Settings(o.min_tokens, o.similarity, o.scope == "file", o.min_clone_lines, o.max_bucket, o.max_pairs, 0 if o.max_memory == "auto" else C.bytes_of(o.max_memory))
    changed = G.changed_lines(o.path, o.since) if o.since else None
    scope = None
    if changed is not None:
        names = spark.createDataFrame([(x,) for x in changed], "path string")
        scope = files.join(F.broadcast(names), "path", "left_semi").select("file_id")
    c, done = scan_clones(files, o.rules, settings, scope)
    c = cut_lineage(c)
    say(f"{done.evaluated} pairs of blocks compared")
    if o.staged or changed is not None:
        # What was changed or staged is a short list of the driver's; the clones are met with it where they are.
        ranges = [(f, a, b) for f, rs in changed.items() for a, b in rs] if changed is not None else []
        each = c.select("key", F.explode("instances").alias("i")).select("key", F.col("i.path").alias("path"), F.col("i.start_line").alias("lo"), F.col("i.end_line").alias("hi"))
        if o.staged:
            staged = F.broadcast(spark.createDataFrame([(x,) for x in G.staged_files(o.path)], "path string"))
            c = c.join(each.join(staged, "path", "left_semi"), "key", "left_semi")
        if changed is not None:
            cuts = F.broadcast(spark.createDataFrame(ranges, "path string, a int, b int"))
            c = c.join(each.join(cuts, "path").where("lo <= b and a <= hi").select("key"), "key", "left_semi")
    lines = files.select("path", line_count(F.col("text")).alias("total"))
    ranges = c.select(F.explode("instances").alias("i")).select(F.col("i.path").alias("path"), F.col("i.start_line").alias("lo"), F.col("i.end_line").alias("hi"))
    stats = lines.join(covered_lines(ranges, "path"), "path").collect()
    total = lines.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    pct = lambda d, t: int(d * 1000 / max(t, 1) + 0.5) / 10
    churn = G.commit_counts(o.path, o.churn_days) if o.git_churn else {}
    clones = []
    for r in c.orderBy(F.desc("line_count"), "hash", "clone").toLocalIterator():
        inst = [
            {"file": i.path, "start_line": i.start_line, "end_line": i.end_line, **({"function": i.function} if i.function else {}), **({"is_test": True} if t else {}), **({"commits": churn[i.path]} if i.path in churn else {})}
            for i, t in zip(r.instances, r.tests)
        ]
        if r.lines:
            inst[0]["lines"] = list(r.lines)
        dirs, names = {i["file"].rpartition("/")[0] for i in inst}, {i["file"] for i in inst}
        kind = "cross-dir" if len(dirs) > 1 else "cross-file" if len(names) > 1 else "same-file"
        x = {"hash": r.hash, "type": r.clone_type, "similarity": r.similarity, "line_count": r.line_count, "token_count": r.token_count, "saved_lines": (len(inst) - 1) * r.line_count, "scope": kind, "instances": inst}
        if o.rules:
            x |= {"rule": r.rule, "rule_min_tokens": r.rule_tokens}
        if o.git_churn:
            x["churn"] = sum(i.get("commits", 0) for i in inst)
        clones.append(x)
    if o.git_churn:
        clones.sort(key=lambda x: -x["churn"])
    ignore = C.find_ignore_file(o.ignore_file, root)
    if ignore:
        rules = G.parse_ignore(Path(ignore).read_text())
        for x in clones:
            x["suppressed"] = G.is_suppressed(x, rules)
    if o.write_baseline:
        Path(o.write_baseline).write_text(G.write_baseline(clones, o.min_tokens))
    known = new = 0
    if o.baseline:
        known, new = G.mark_known([x for x in clones if not x.get("suppressed")], G.read_baseline(Path(o.baseline).read_text()))
    live = [x for x in clones if not x.get("suppressed") and not x.get("baseline")]
    dup = sum(s.covered for s in stats)
    report = {
        "total_files": total_files, "scanned_files": n, "skipped_files": total_files - n, "total_clones": len(live), "total_lines": int(total), "duplicate_lines": int(dup), "duplication_pct": pct(dup, total),
        "saved_lines": sum(x["saved_lines"] for x in live),
        "file_stats": sorted(({"file": s.path, "total_lines": s.total, "duplicate_lines": int(s.covered), "duplication_pct": pct(s.covered, s.total)} for s in stats), key=lambda s: (-s["duplication_pct"], s["file"])),
        "clones": clones if o.show_suppressed else live,
    }
    if done.partial:
        report |= {"partial": True, "partial_reason": done.reason}
    if o.baseline:
        report |= {"baseline_known": known, "baseline_new": new}
    if o.dead_code:
        # A function is used wherever in the tree it is named, whatever the scan leaves out.
        universe = read_tree(spark, root, [], [], "", o.max_file_size)
        rows = dead_functions(files, universe, text_words(spark, root, o.max_file_size)).orderBy("confidence", "path", "line").collect()
        report["dead_functions"] = [{"file": r.path, "line": r.line, "name": r.name, "confidence": r.confidence} for r in rows]
    return report


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    if o.command == "version":
        from . import __version__

        print(__version__)
        return 0
    if o.command == "init":
        target = Path(C.CONFIG_NAME)
        if target.exists() and not o.force:
            print(f"error: {target} exists; --force overwrites it", file=sys.stderr)
            return 2
        target.write_text(C.STARTER)
        print(f"wrote {target}")
        return 0
    from .session import build_session

    try:
        o = settle(o)
        report = scan(build_session("scan"), o)
        text = render(report, o.format, -1 if o.verbose else o.top or -1)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if o.output:
        Path(o.output).write_text(text)
    else:
        print(text, end="")
    if report.get("partial") and not o.quiet:
        print(f"warning: {report['partial_reason']}", file=sys.stderr)
    new = [c for c in report["clones"] if not c.get("suppressed") and not c.get("baseline")]
    found = report["duplication_pct"] >= o.min_duplication if o.min_duplication else bool(new)
    return int(found and not o.exit_zero)


if __name__ == "__main__":
    sys.exit(main())
