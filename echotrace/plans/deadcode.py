"""Functions that nothing refers to: definitions, usages, and a scoped anti-join between them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.paths import base_name, dir_name
from ..operators.skew import spread
from ..session import cut_lineage
from .detect import language_of, run_files

_EXEMPT = re.compile(r"^(main|Main|init|__\w+__|test.*|Test.*|Benchmark.*|Example.*|Fuzz.*|setUp|tearDown|setup|teardown|constructor|initialize)$")
# Methods that Java's serialization calls, and words and modifiers that say who may call a function.
SERIALIZATION = frozenset("writeObject readObject readObjectNoData writeReplace readResolve".split())
MODULE_WORDS = frozenset("import export require module exports".split())
LINE_LANGUAGES = frozenset("kotlin scala swift python ruby".split())
WORD = r"[A-Za-z_][A-Za-z0-9_]*"


def _said(t) -> str:
    return t.text + t.orig


def _declared_from(tokens, at: int, lang: str) -> int:
    """Index of the first token of the declaration whose name stands at `at`: after the last item, or at the start of its line and of annotations above."""
    start = at
    if lang in LINE_LANGUAGES:
        while start > 0 and (tokens[start - 1].line == tokens[at].line or tokens[next((j for j in range(start - 1, -1, -1) if j == 0 or tokens[j - 1].line != tokens[start - 1].line), 0)].text == "@"):
            start -= 1
        return start
    depth = 0
    while start > 0:
        x = tokens[start - 1].text
        depth += (x in (")", "]")) - (x in ("(", "["))
        if depth <= 0 and x in (";", "{", "}"):
            break
        start -= 1
    return start


def visibility(name: str, lang: str, path: str, before: list[str], module: bool) -> str:
    """repo, tree (the folder and those below), dir or file: how far a definition reaches."""
    if lang == "go":
        return "repo" if name[:1].isupper() else "dir"
    if lang == "rust":
        return "repo" if "pub" in before else "tree"
    if lang == "dart":
        return "dir" if name.startswith("_") else "repo"
    if lang in ("javascript", "typescript"):
        return "repo" if not module or {"export", "default"} & set(before) else "file"
    if lang == "csharp":
        return "dir" if "private" in before else "repo"
    if lang in ("c", "cpp"):
        return "file" if "static" in before and not re.search(r"\.(h|hpp|hxx|hh)$", path) else "repo"
    return "file" if {"private", "fileprivate"} & set(before) else "repo"


def _dispatched(tokens, start: int, at: int, body: int, name: str, lang: str) -> bool:
    """Whether something reaches the function without naming it: annotations, attributes, overrides and hooks."""
    before = [_said(t) for t in tokens[start:at]]
    if lang == "java" and name in SERIALIZATION or lang == "csharp" and before[:1] == ["["] or lang == "rust" and "#" in before:
        return True
    return bool({"@", "override", "virtual", "abstract"} & set(before) or {"override", "final"} & {_said(t) for t in tokens[at + 1 : body]})


def _classes(tokens, pair) -> list[tuple[int, int, bool]]:
    """(first, last token, whether it extends or implements anything) of class bodies."""
    out = []
    for i, t in enumerate(tokens):
        if t.text == "class":
            j = next((j for j in range(i + 1, min(i + 60, len(tokens))) if tokens[j].text in ("{", ";", ")")), -1)
            if j > 0 and tokens[j].text == "{" and pair[j] > 0:
                out.append((j + 1, pair[j] - 1, any(_said(x) in ("extends", "implements") for x in tokens[i:j])))
    return out


def _js_definition(tokens, spans, classes, at: int, start: int) -> bool:
    """Whether the function named at `at` is one that a call by name reaches: declared, assigned in a module, or a plain member of a plain class."""
    prev, nxt = _said(tokens[at - 1]) if at else "", _said(tokens[at + 1]) if at + 1 < len(tokens) else ""
    if prev == "function" or prev == "*":
        return at < 3 or tokens[at - 2].text not in ("=", ":", "(", ",", "return")
    inner = max(((a, b, d) for a, b, d in classes if a <= at <= b), default=None)
    within = [x for x in spans if x[0] <= at <= x[1] and (inner is None or x[0] > inner[0])]
    if within:
        return False  # defined in a function
    if inner is not None:
        return not inner[2] and not {"get", "set", "@"} & {_said(t) for t in tokens[start:at]}
    return nxt in ("=", ":") and prev in ("const", "let", "var")


def definitions_and_usages(files: DataFrame, definitions: bool = True) -> DataFrame:
    """(run_id, path, kind, name, line, visibility): named functions as 'def', other mentions of a word as 'use', names of included files as 'include'.

    Words inside strings count as mentions. A function's own name where it is defined, and mentions within its own body,
    are no usages. Entry points, tests, special methods and what is dispatched by other means are no definitions.
    """
    from ..functions import lexer
    from ..functions.masks import partners

    def run(batches):
        for pdf in batches:
            rows = []
            for r, p, text in zip(pdf["run_id"], pdf["path"], pdf["text"]):
                lang = language_of(p)
                tokens = lexer.lex(text, lang)
                spans = lexer.functions(tokens, lang)
                js = lang in ("javascript", "typescript")
                classes = _classes(tokens, partners(tokens)) if js else []
                module = js and any(_said(t) in MODULE_WORDS for t in tokens)
                own: dict[str, list[tuple[int, int]]] = {}
                for a, b, name in spans:
                    short = re.split(r"[.:]", name)[-1]
                    if not short:
                        continue
                    at = next((k for k in range(a - 1, max(a - 60, -1), -1) if tokens[k].orig == short), a)
                    own.setdefault(short, []).append((at, b))
                    start = _declared_from(tokens, at, lang)
                    before = [_said(t) for t in tokens[start:at]]
                    if not definitions or _EXEMPT.match(short) or _dispatched(tokens, start, at, a, short, lang) or js and not _js_definition(tokens, spans, classes, at, start):
                        continue
                    if lang == "go" and "." in name or lang == "go" and short[:1].isupper() and at and tokens[at - 1].text == ")":
                        continue  # an exported method may serve an interface
                    member = js and any(x <= at <= y for x, y, _ in classes)
                    reach = ("file" if "private" in before else "repo") if member else visibility(short, lang, p, before, module)
                    rows.append((r, p, "def", short, tokens[at].line, reach))
                seen = set()
                for k, t in enumerate(tokens):
                    if t.text == "#" and k + 2 < len(tokens) and _said(tokens[k + 1]) == "include" and tokens[k + 2].kind == lexer.STRING:
                        rows.append((r, p, "include", tokens[k + 2].orig.strip('"<>').rsplit("/", 1)[-1], None, None))
                    for w in [t.orig] if t.kind == lexer.NAME else re.findall(WORD, t.orig) if t.kind == lexer.STRING else []:
                        if w not in seen and not any(a <= k <= b for a, b in own.get(w, ())):
                            seen.add(w)
                            rows.append((r, p, "use", w, None, None))
            yield pd.DataFrame(rows, columns=["run_id", "path", "kind", "name", "line", "visibility"]).astype({"line": "Int32"})

    return spread(files.select("path", "run_id", "text"), "path").select("run_id", "path", "text").mapInPandas(run, "run_id int, path string, kind string, name string, line int, visibility string")


def text_words(spark, root: str, max_size: int = 5 * 1024 * 1024) -> DataFrame:
    """(run_id, name): the distinct words of a tree's templates, configuration and documentation."""
    from ..sources.tree import read_texts

    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"\b({WORD})"), F.lit(1))))
    return read_texts(spark, root, max_size).select(F.lit(0).alias("run_id"), words.alias("name")).distinct()


def dead_functions(files: DataFrame, universe: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """(run_id, path, line, name, confidence): definitions in `files` that no usage reaches; high confidence unless known everywhere.

    Usages come from `files` and from `universe`, which may hold more files than are judged; `words` (run_id, name) of other texts reach only what
    is known everywhere. What is local to an included C file is its includers' too.
    """
    rows = cut_lineage(definitions_and_usages(files))
    used = rows if universe is None else rows.unionByName(definitions_and_usages(universe.join(files.select("path").distinct(), "path", "left_anti"), False))
    included = used.where("kind = 'include'").select("run_id", F.col("name").alias("base")).distinct()
    d = rows.where("kind = 'def'").select("run_id", "path", dir_name(F.col("path")).alias("dir"), base_name(F.col("path")).alias("base"), "name", "line", "visibility")
    d = d.join(included.withColumn("promoted", F.lit(True)), ["run_id", "base"], "left").withColumn("visibility", F.when((F.col("visibility") == "file") & F.col("promoted"), "repo").otherwise(F.col("visibility")))
    u = used.where("kind = 'use'").select(F.col("run_id").alias("r"), F.col("path").alias("p"), dir_name(F.col("path")).alias("d"), F.col("name").alias("n")).distinct()
    if words is not None:
        u = u.unionByName(words.select(F.col("run_id").alias("r"), F.lit("\0").alias("p"), F.lit("\0").alias("d"), F.col("name").alias("n")))
    below = (F.col("d") == F.col("dir")) | (F.col("dir") == ".") & (F.col("d") != "\0") | F.col("d").startswith(F.concat(F.col("dir"), F.lit("/")))
    reach = (F.col("visibility") == "repo") | ((F.col("visibility") == "dir") & (F.col("d") == F.col("dir"))) | ((F.col("visibility") == "tree") & below) | (F.col("p") == F.col("path"))
    dead = d.join(u, F.col("run_id").eqNullSafe(F.col("r")) & (F.col("name") == F.col("n")) & reach, "left_anti")
    return dead.select("run_id", "path", "line", "name", F.when(F.col("visibility") == "repo", "low").otherwise("high").alias("confidence"))


def detect_dead_functions(spark, sf_dir):
    """Functions of every run's files that nothing in the run refers to."""
    return dead_functions(run_files(spark, sf_dir))


QUERIES = {"detect_dead_functions": detect_dead_functions}
ORACLES: dict[str, str] = {}
