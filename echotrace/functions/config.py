"""The configuration file of a scan: a small reader of block YAML, lookup, defaults and the starter file.

Understood are mappings, lists (with dashes or in brackets), quoted and plain scalars and comments, which is all that the file needs; anything
else is an error that names its line.
"""

from __future__ import annotations

import re
from pathlib import Path

CONFIG_NAME, IGNORE_NAME = ".echotrace.yml", ".echotrace-ignore"
STARTER = """# Defaults of a scan; what the command line says comes first.
scan:
  path: .
  min-tokens: 50
  # language: go
  exclude: []
  include: []
  top: 10
  # baseline: baseline.json
# The first rule that matches a file sets its thresholds.
# rules:
#   - name: tests
#     paths: ["**/*_test.*", "**/tests/**"]
#     min-tokens: 25
#   - paths: ["third_party/**"]
#     skip: true
"""


class Line(dict):
    """A mapping that remembers the line it began on and the line of each key."""

    line = 0

    def __init__(self):
        super().__init__()
        self.lines: dict[str, int] = {}


def _scalar(s: str, n: int):
    s = s.strip()
    if s[:1] in ("'", '"'):
        if len(s) < 2 or s[-1] != s[0]:
            raise ValueError(f"line {n}: unclosed quote")
        return s[1:-1].replace('\\"', '"').replace("\\\\", "\\") if s[0] == '"' else s[1:-1].replace("''", "'")
    if s[:1] == "[":
        if s[-1] != "]":
            raise ValueError(f"line {n}: unclosed list")
        return [_scalar(x, n) for x in re.findall(r"\"(?:\\.|[^\"\\])*\"|'[^']*'|[^,\s][^,]*", s[1:-1])]
    if s in ("", "~", "null"):
        return None
    if s in ("true", "false"):
        return s == "true"
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    if re.fullmatch(r"[-+]?\d*\.\d+", s):
        return float(s)
    if s[0] in "{&*!|>%@`":
        raise ValueError(f"line {n}: {s[0]} is not understood here")
    return s


_KEY = re.compile(r"([A-Za-z_][\w-]*)\s*:(?:\s+(.*)|$)")


def _bare(line: str) -> str:
    """The line without its comment."""
    out, quote = [], ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            break
        out.append(c)
    return "".join(out).rstrip()


def read_yaml(text: str):
    """Nested mappings (Line), lists and scalars; None for an empty text."""
    rows = [(len(b) - len(b.lstrip()), b.strip(), n) for n, raw in enumerate(text.splitlines(), 1) if (b := _bare(raw)).strip() and b.strip() != "---"]
    for _, _, n in rows:
        if "\t" in text.splitlines()[n - 1][: len(text.splitlines()[n - 1]) - len(text.splitlines()[n - 1].lstrip())]:
            raise ValueError(f"line {n}: tabs can't indent")

    def block(i: int, indent: int):
        if rows[i][1].startswith("- ") or rows[i][1] == "-":
            out = []
            while i < len(rows) and rows[i][0] == indent and (rows[i][1].startswith("- ") or rows[i][1] == "-"):
                rest, n = rows[i][1][1:].strip(), rows[i][2]
                if not rest:
                    deeper = i + 1 < len(rows) and rows[i + 1][0] > indent
                    value, i = block(i + 1, rows[i + 1][0]) if deeper else (None, i + 1)
                elif _KEY.fullmatch(rest):
                    inner = indent + len(rows[i][1]) - len(rest)
                    rows[i] = (inner, rest, n)
                    value, i = block(i, inner)
                else:
                    value, i = _scalar(rest, n), i + 1
                out.append(value)
            return out, i
        out = Line()
        out.line = rows[i][2]
        while i < len(rows) and rows[i][0] == indent:
            m, n = _KEY.fullmatch(rows[i][1]), rows[i][2]
            if not m:
                raise ValueError(f"line {n}: expected a key")
            if m[1] in out:
                raise ValueError(f"line {n}: {m[1]} is set twice")
            i += 1
            if m[2]:
                out[m[1]] = _scalar(m[2], n)
            elif i < len(rows) and (rows[i][0] > indent or rows[i][0] == indent and rows[i][1].startswith("-")):
                out[m[1]], i = block(i, rows[i][0])
            else:
                out[m[1]] = None
            out.lines[m[1]] = n
        if i < len(rows) and rows[i][0] > indent:
            raise ValueError(f"line {rows[i][2]}: indented too far")
        return out, i

    if not rows:
        return None
    value, i = block(0, rows[0][0])
    if i < len(rows):
        raise ValueError(f"line {rows[i][2]}: indented too little")
    return value


def find_upwards(start: str, name: str = CONFIG_NAME) -> str:
    """The first such file in a folder or those above it; empty if there is none."""
    here = Path(start).resolve()
    return next((str(d / name) for d in (here, *here.parents) if (d / name).is_file()), "")


def find_ignore_file(explicit: str, root: str) -> str:
    """The named file, else the one in the scanned folder (the folder of a single file), else in the current one; empty if there is none."""
    base = Path(root) if Path(root).is_dir() else Path(root).parent
    tries = ([Path(explicit)] if explicit else []) + [base / IGNORE_NAME, Path(IGNORE_NAME)]
    return next((str(p) for p in tries if p.is_file()), "")


def load_config(path: str) -> dict:
    """The file as {'scan': {...}, 'rules': [...]}; an empty path gives no settings."""
    data = (read_yaml(Path(path).read_text()) if path else None) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return {"scan": data.get("scan") or {}, "rules": data.get("rules"), "rules_line": getattr(data, "lines", {}).get("rules", 0)}


def bytes_of(size: str) -> int:
    """A size like 512M, 2GiB or 1.5g in bytes; a number alone is bytes."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*", size.lower())
    if not m:
        raise ValueError(f"not a size: {size!r}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2] or " "))
