"""Suppression rules, baselines, per-path rules and git references: small inputs read and checked on the driver."""

from __future__ import annotations

import json
import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from .paths import glob_regex


@dataclass(frozen=True)
class IgnoreRule:
    prefix: str = ""
    glob: str = ""
    file: str = ""
    lo: int = 0
    hi: int = 0


def parse_ignore(text: str) -> list[IgnoreRule]:
    """One rule per line: path:start-end, 8 or more hex digits as a hash prefix, else a glob; # begins a comment."""
    out = []
    for line in text.splitlines():
        s = line.split("#", 1)[0].strip()
        if not s:
            continue
        m = re.fullmatch(r"(.+):(\d+)-(\d+)", s)
        if m:
            out.append(IgnoreRule(file=m[1], lo=int(m[2]), hi=int(m[3])))
        elif re.fullmatch(r"[0-9a-fA-F]{8,}", s):
            out.append(IgnoreRule(prefix=s.lower()))
        else:
            out.append(IgnoreRule(glob=s))
    return out


def is_suppressed(clone: dict, rules: list[IgnoreRule]) -> bool:
    """By hash prefix, by a glob on the path or base name of an instance, or by an overlapping range of a file's suffix."""
    for r in rules:
        if r.prefix and clone["hash"].lower().startswith(r.prefix):
            return True
        for i in clone["instances"]:
            p = i["file"]
            if r.glob and (re.match(glob_regex(r.glob), p) or re.match(glob_regex(r.glob), p.rsplit("/", 1)[-1])):
                return True
            if r.file and p.endswith(r.file) and i["start_line"] <= r.hi and r.lo <= i["end_line"]:
                return True
    return False


def write_baseline(clones: list[dict], min_tokens: int) -> str:
    """Version 1: the most instances of each fingerprint that isn't suppressed, keys in order, a line end at the end."""
    prints: dict[str, int] = {}
    for c in clones:
        if not c.get("suppressed"):
            prints[c["hash"]] = max(prints.get(c["hash"], 0), len(c["instances"]))
    return json.dumps({"version": 1, "min_tokens": min_tokens, "fingerprints": dict(sorted(prints.items()))}, indent=2) + "\n"


def read_baseline(text: str) -> dict[str, int]:
    data = json.loads(text)
    if data.get("version") != 1:
        raise ValueError(f"baseline version {data.get('version')} is not 1")
    return data.get("fingerprints") or {}


def mark_known(clones: list[dict], prints: dict[str, int]) -> tuple[int, int]:
    """Set `baseline` on clones with no more instances than recorded; (known, new) counts."""
    for c in clones:
        c["baseline"] = c["hash"] in prints and len(c["instances"]) <= prints[c["hash"]]
    known = sum(c["baseline"] for c in clones)
    return known, len(clones) - known


@dataclass(frozen=True)
class Rule:
    """Thresholds of the files that its globs match; what is None is as in the scan. `index` is its place, after all rules for the scan itself."""

    name: str
    paths: tuple[str, ...]
    min_tokens: int | None = None
    similarity: float | None = None
    skip: bool = False
    index: int = 0


RULE_KEYS = ("name", "paths", "min-tokens", "similarity", "skip")
#: The name of what holds where no rule does.
SCAN = "scan"


def parse_rules(items: list | None, line: int = 0) -> list[Rule]:
    """Checked rules; an error names the rule and, where known, its line."""
    if items is None:
        return []
    if not isinstance(items, list):
        raise ValueError(f"rules (line {line}): must be a list")
    out: list[Rule] = []
    for n, x in enumerate(items):

        def fail(key: str, why: str):
            at = getattr(x, "lines", {}).get(key, getattr(x, "line", 0))  # noqa: B023
            raise ValueError(f"rules[{n}] ({x.get('name') + ', ' if isinstance(x, dict) and x.get('name') else ''}line {at}): {why}")  # noqa: B023

        if not isinstance(x, dict):
            raise ValueError(f"rules[{n}]: must be a mapping with paths")
        if unknown := [k for k in x if k not in RULE_KEYS]:
            fail(unknown[0], f"unknown key {unknown[0]!r}; known: {', '.join(RULE_KEYS)}")
        paths = x.get("paths")
        if not isinstance(paths, (list, tuple)) or not paths:
            fail("paths", "paths must list at least one glob")
        for p in paths:
            if not isinstance(p, str) or not p.strip():
                fail("paths", "empty glob in paths")
            try:
                re.compile(glob_regex(p))
            except re.error:
                fail("paths", f"not a glob: {p!r}")
        k, s = x.get("min-tokens"), x.get("similarity")
        if "min-tokens" in x and (not isinstance(k, int) or k <= 0):
            fail("min-tokens", f"min-tokens must be greater than 0, not {k}")
        if "similarity" in x and (not isinstance(s, (int, float)) or not 0.5 <= s <= 1):
            fail("similarity", f"similarity must be between 0.50 and 1.00, not {s}")
        if x.get("skip") and ("min-tokens" in x or "similarity" in x):
            fail("skip", "a rule that skips can't set min-tokens or similarity")
        if x.get("name") == SCAN:
            fail("name", f"the name {SCAN!r} is taken")
        if x.get("name") and any(r.name == x["name"] for r in out):
            fail("name", f"the name {x['name']!r} is used twice")
        out.append(Rule(x.get("name") or f"rules[{n}]", tuple(paths), k, s, bool(x.get("skip")), n))
    return out


def rule_globs(rule: Rule) -> list[str]:
    """The rule's globs; a leading **/ also matches no folder."""
    return [t for g in rule.paths for t in ([g, g[3:]] if g.startswith("**/") and len(g) > 3 else [g])]


def rule_for(path: str, rules: list[Rule]) -> Rule | None:
    """The first rule that matches."""
    for r in rules:
        if any(re.match(glob_regex(t), path) or ("**" not in t and re.match(glob_regex(t), path.rsplit("/", 1)[-1])) for t in rule_globs(r)):
            return r
    return None


def parse_hunks(diff: str) -> list[tuple[int, int]]:
    """Changed line ranges of a unified diff's new side."""
    out = []
    for s, c in re.findall(r"(?m)^@@[^\n]*? \+(\d+)(?:,(\d+))?", diff):
        n = int(c) if c else 1
        if n:
            out.append((int(s), int(s) + n - 1))
    return out


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def resolve_ref(root: str, ref: str) -> str:
    if not ref or ref.startswith("-"):
        raise ValueError(f"not a git reference: {ref!r}")
    sha = _git(root, "rev-parse", ref).strip()
    if not re.fullmatch(r"[0-9a-f]{4,40}", sha):
        raise ValueError(f"not a git reference: {ref!r}")
    return sha


def _below(root: str, top: str, name: str) -> str | None:
    """A path of a repository as seen from the scanned folder or file; None outside of it."""
    base, path = Path(root).resolve(), Path(top).resolve() / name
    if base == path:
        return path.name
    return path.relative_to(base).as_posix() if base in path.parents else None


def _folder(root: str) -> str:
    return str(Path(root) if Path(root).is_dir() else Path(root).resolve().parent)


def changed_lines(root: str, ref: str) -> dict[str, list[tuple[int, int]]]:
    """Ranges per file that HEAD changed since the reference; files are named from the scanned folder, those outside left out."""
    where = _folder(root)
    sha, top = resolve_ref(where, ref), _git(where, "rev-parse", "--show-toplevel").strip()
    out = {}
    for n in _git(top, "-c", "core.quotepath=off", "diff", "--name-only", f"{sha}...HEAD").splitlines():
        rel = _below(root, top, n)
        if rel is not None and (r := parse_hunks(_git(top, "diff", "-U0", f"{sha}...HEAD", "--", n))):
            out[rel] = r
    return out


def staged_files(root: str) -> list[str]:
    """Staged files, named from the scanned folder; none outside a repository."""
    try:
        where = _folder(root)
        top = _git(where, "rev-parse", "--show-toplevel").strip()
        names = _git(top, "-c", "core.quotepath=off", "diff", "--cached", "--name-only", "--diff-filter=ACM").splitlines()
        return [r for n in names if (r := _below(root, top, n)) is not None]
    except subprocess.CalledProcessError:
        return []


def commit_counts(root: str, days: int = 90) -> dict[str, int]:
    """Commits of the last days per file, named from the scanned folder, in one call of git; empty where git fails."""
    try:
        where = _folder(root)
        top = _git(where, "rev-parse", "--show-toplevel").strip()
        names = _git(where, "-c", "core.quotepath=off", "log", "--format=", "--name-only", f"--since={days} days ago").splitlines()
    except subprocess.CalledProcessError:
        return {}
    out: dict[str, int] = {}
    for n in names:
        if n and (rel := _below(root, top, n)) is not None:
            out[rel] = out.get(rel, 0) + 1
    return out
