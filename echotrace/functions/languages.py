"""The languages a scan knows: names, extensions and comment marks (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    line_comments: tuple[str, ...]
    block_comment: tuple[str, str] | None


_C = (("//",), ("/*", "*/"))
LANGUAGES = [
    Language("go", (".go",), *_C),
    Language("python", (".py",), ("#",), None),
    Language("javascript", (".js", ".mjs", ".cjs", ".jsx"), *_C),
    Language("typescript", (".ts", ".tsx", ".mts", ".cts"), *_C),
    Language("java", (".java",), *_C),
    Language("kotlin", (".kt", ".kts"), *_C),
    Language("rust", (".rs",), *_C),
    Language("c", (".c", ".h"), *_C),
    Language("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hxx"), *_C),
    Language("csharp", (".cs",), *_C),
    Language("swift", (".swift",), *_C),
    Language("scala", (".scala",), *_C),
    Language("php", (".php",), ("//", "#"), ("/*", "*/")),
    Language("ruby", (".rb",), ("#",), None),
    Language("shell", (".sh", ".bash", ".zsh"), ("#",), None),
    Language("sql", (".sql",), ("--",), ("/*", "*/")),
    Language("lua", (".lua",), ("--",), ("--[[", "]]")),
    Language("elixir", (".ex", ".exs"), ("#",), None),
    Language("dart", (".dart",), *_C),
    Language("r", (".r",), ("#",), None),
]
BY_NAME = {x.name: x for x in LANGUAGES}
BY_EXTENSION = {e: x.name for x in LANGUAGES for e in x.extensions}
