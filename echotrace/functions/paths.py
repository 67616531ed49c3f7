"""Path expressions and the two glob dialects, as regular expressions for rlike."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Directories that a scan never enters, besides hidden ones (fixed values).
PRUNED_DIRS = ("vendor", "node_modules", "dist", "build", "target", "__pycache__", "testdata")


def slashed(c: Column) -> Column:
    """Forward slashes and no leading ./ ."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dir_name(c: Column) -> Column:
    """The part before the last slash; '.' without one."""
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit("."))


def extension(c: Column) -> Column:
    """The last extension in lower case with its dot; empty without one."""
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


def in_pruned_dir(c: Column) -> Column:
    """Whether any directory of the path is hidden or one of PRUNED_DIRS."""
    parts = F.split(c, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: (d.startswith(".") & ~d.isin(".", "..")) | d.isin(*PRUNED_DIRS))


def _class_end(glob: str, i: int) -> int:
    j = i + 1
    if j < len(glob) and glob[j] in "!^":
        j += 1
    if j < len(glob) and glob[j] == "]":
        j += 1
    while j < len(glob) and glob[j] != "]":
        j += 1
    return j


def glob_regex(glob: str) -> str:
    """An anchored regular expression. With ** in it, ** crosses slashes and {a,b} are alternatives; else braces are literal."""
    wide = "**" in glob
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (j := _class_end(glob, i)) < len(glob):
            body = glob[i + 1 : j]
            out.append("[" + ("^" + body[1:] if body[:1] in ("!", "^") else body).replace("\\", "\\\\") + "]")
            i = j
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif wide and c == "{":
            depth += 1
            out.append("(?:")
        elif wide and c == "}" and depth:
            depth -= 1
            out.append(")")
        elif wide and c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob_match(path: Column, glob: str) -> Column:
    """With ** the glob must match the whole path; else the base name or the whole path."""
    r = glob_regex(glob)
    return path.rlike(r) if "**" in glob else (base_name(path).rlike(r) | path.rlike(r))


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any exclude drops; a non-empty include must match at least once."""
    keep = F.lit(not include)
    for g in include:
        keep = keep | glob_match(path, g)
    for g in exclude:
        keep = keep & ~glob_match(path, g)
    return keep


def is_test(path: Column) -> Column:
    """Test files by the conventions of their language, then by any base name with 'test' or 'spec' in it."""
    p, b = F.lower(path), F.lower(base_name(path))
    return (
        b.endswith("_test.go")
        | b.rlike(r"\.(spec|test)\.")
        | p.contains("__tests__/")
        | (b.endswith(".py") & (b.startswith("test_") | b.endswith("_test.py") | p.contains("/tests/")))
        | p.contains("src/test/")
        | (b.endswith(".rb") & (p.rlike(r"(^|/)spec/") | b.endswith("_spec.rb")))
        | b.contains("test")
        | b.contains("spec")
    )
