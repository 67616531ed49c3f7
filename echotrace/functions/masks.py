"""What lies where in a file's tokens: function bodies, executable code, imports, ignored functions, and literals that are data.

Everything works on bracket partners found in one pass, so each mask is linear in the file.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .languages import BY_NAME
from .lexer import KEYWORD, NAME, NUMBER, OPERATOR, STRING, Span, Token, functions, imports

# Languages in which the bracket alone tells a literal from a block or an index.
LIST_LITERALS = frozenset("python javascript typescript ruby rust php elixir swift dart".split())
BRACE_LITERALS = frozenset("python lua elixir".split())
OBJECT_LITERALS = frozenset("javascript typescript".split())
#: Languages whose blocks say nothing of being functions.
DEPTH_LANGUAGES = frozenset("java c cpp csharp dart".split())
#: What may stand between a parameter list and the body: arrows, qualified and generic names.
_HEADER_SIGNS = frozenset("-> => , . < > :: [ ] ?".split())
_VALUE_BEFORE = frozenset("= : , ( [ ? default".split())
#: A comment with such a mark before a function keeps it out of every finding.
IGNORE_MARK = re.compile(r"\b[\w-]+:ignore\b")


class Masks(NamedTuple):
    """Flags per token, and spans (first, last token)."""

    inside: list[bool]
    logic: list[bool]
    imports: list[bool]
    ignored: list[bool]
    spans: list[Span]
    tables: list[tuple[int, int]]
    objects: list[tuple[int, int]]
    code_in_tables: list[tuple[int, int]]


def partners(tokens: list[Token]) -> list[int]:
    """For each opening bracket the index of the one that closes it, each kind counted by itself; -1 elsewhere and where none does."""
    out = [-1] * len(tokens)
    open_at: dict[str, list[int]] = {")": [], "]": [], "}": []}
    closes = {"(": ")", "[": "]", "{": "}"}
    for i, t in enumerate(tokens):
        if t.kind != OPERATOR:
            continue
        if t.text in closes:
            open_at[closes[t.text]].append(i)
        elif t.text in open_at and open_at[t.text]:
            out[open_at[t.text].pop()] = i
    return out


def _op(tokens: list[Token], i: int, *texts: str) -> bool:
    return 0 <= i < len(tokens) and tokens[i].kind == OPERATOR and tokens[i].text in texts


def _opens_value(tokens: list[Token], i: int) -> bool:
    """Whether the bracket at i begins a literal: an index follows what it indexes."""
    if i == 0:
        return True
    t = tokens[i - 1]
    return not (t.kind in (NAME, NUMBER, STRING) or t.kind == OPERATOR and t.text in ")]}")


def _type_end(tokens: list[Token], pair: list[int], i: int) -> int:
    """Index after the Go type that begins at i; -1 for what can't precede a literal's body."""
    while 0 <= i < len(tokens):
        t = tokens[i]
        if _op(tokens, i, "["):
            i = pair[i] + 1 or -1
        elif t.kind == KEYWORD and t.text == "map":
            i = pair[i + 1] + 1 or -1 if _op(tokens, i + 1, "[") else -1
        elif _op(tokens, i, "*"):
            i += 1
        elif t.kind == KEYWORD and t.text in ("struct", "interface"):
            return pair[i + 1] + 1 or -1 if _op(tokens, i + 1, "{") else -1
        elif t.kind == NAME:
            i += 3 if _op(tokens, i + 1, ".") and i + 2 < len(tokens) and tokens[i + 2].kind == NAME else 1
            return (pair[i] + 1 or -1) if _op(tokens, i, "[") else i
        else:
            return -1
    return -1


def table_spans(tokens: list[Token], lang: str, pair: list[int]) -> list[tuple[int, int]]:
    """Outermost literals of collections."""
    out, i = [], 0
    while i < len(tokens):
        end = -1
        if lang == "go":
            if tokens[i].kind == KEYWORD and tokens[i].text == "map" or _op(tokens, i, "[") and _opens_value(tokens, i):
                body = _type_end(tokens, pair, i)
                end = pair[body] if _op(tokens, body, "{") else -1
        elif lang in LIST_LITERALS and _op(tokens, i, "[") and _opens_value(tokens, i) or lang in BRACE_LITERALS and _op(tokens, i, "{"):
            end = pair[i]
        if end >= 0:
            out.append((i, end))
            i = end
        i += 1
    return out


def object_spans(tokens: list[Token], lang: str, pair: list[int], logic: list[bool]) -> list[tuple[int, int]]:
    """Object literals outside executable code."""
    out, i = [], 1
    while lang in OBJECT_LITERALS and i < len(tokens):
        if _op(tokens, i, "{") and not logic[i] and tokens[i - 1].text + tokens[i - 1].orig in _VALUE_BEFORE and pair[i] >= 0:
            out.append((i, pair[i]))
            i = pair[i]
        i += 1
    return out


def _go_literal_body(tokens: list[Token], pair: list[int], i: int) -> int:
    """Index of the brace of the function literal whose func stands at i; -1 where it is a type or a declaration."""
    j = pair[i + 1] + 1 if _op(tokens, i + 1, "(") and pair[i + 1] >= 0 else -1
    if j < 0 or j >= len(tokens):
        return -1
    if not _op(tokens, j, "{"):
        j = pair[j] + 1 if _op(tokens, j, "(") and pair[j] >= 0 else -1 if _op(tokens, j, "(") else _type_end(tokens, pair, j)
    return j if _op(tokens, j, "{") else -1


def code_spans(tokens: list[Token], lang: str, pair: list[int], spans: list[Span], tables: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Function bodies within tables."""
    if not tables:
        return []
    if lang == "go":
        bodies = [(b + 1, pair[b] - 1) for i, t in enumerate(tokens) if t.kind == KEYWORD and t.text == "func" and (b := _go_literal_body(tokens, pair, i)) >= 0 and pair[b] >= 0]
    else:
        # A brace after an assignment, a comma or a bracket holds data, whatever its depth.
        real = lambda a: not _op(tokens, a - 1, "{") or a >= 2 and (tokens[a - 2].kind != OPERATOR or tokens[a - 2].text in (")", "=>", "->"))
        bodies = [(a, b) for a, b, _ in spans if real(a)]
    return [x for x in bodies if any(s <= x[0] and x[1] <= e for s, e in tables)]


def logic_mask(tokens: list[Token], lang: str, inside: list[bool]) -> list[bool]:
    """Executable code: within blocks that follow a parameter list, where a block by itself may be a class."""
    if lang not in DEPTH_LANGUAGES:
        return inside
    out, bodies, depth = [False] * len(tokens), [], 0
    for i, t in enumerate(tokens):
        if t.kind == OPERATOR and t.text == "{":
            if not bodies and _after_parameters(tokens, i):
                bodies.append(depth)
            depth += 1
            continue
        if t.kind == OPERATOR and t.text == "}":
            depth -= 1
            if bodies and bodies[-1] == depth:
                bodies.pop()
                continue
        out[i] = bool(bodies) and inside[i]
    return out


def _after_parameters(tokens: list[Token], brace: int) -> bool:
    for i in range(brace - 1, max(brace - 13, -1), -1):
        if tokens[i].kind == OPERATOR and tokens[i].text not in _HEADER_SIGNS:
            return tokens[i].text == ")"
    return False


def ignore_lines(text: str | None, lang: str) -> set[int]:
    """Numbers of the lines that are comments with an ignore mark."""
    language = BY_NAME.get(lang)
    if not text or language is None or ":ignore" not in text:
        return set()
    starts = (language.line_comments[0], "#", *((language.block_comment[0],) if language.block_comment else ()))
    return {n for n, line in enumerate(text.split("\n"), 1) if IGNORE_MARK.search(line) and line.strip().startswith(starts)}


def ignored_mask(tokens: list[Token], inside: list[bool], marks: set[int]) -> list[bool]:
    """The function that begins within three lines after the line that follows a mark, to its end."""
    out = [False] * len(tokens)
    if not marks:
        return out
    for i, t in enumerate(tokens):
        if t.line - 1 not in marks:
            continue
        j = i + 1
        while j < len(tokens) and (tokens[j].line <= t.line or not inside[j] and tokens[j].line <= t.line + 3):
            j += 1
        while j < len(tokens) and inside[j]:
            out[j] = True
            j += 1
    return out


def masks(tokens: list[Token], lang: str, text: str | None = None) -> Masks:
    """All masks of a file. Ignored functions count as outside of every function; an unknown language has no masks but empty ones."""
    spans = functions(tokens, lang)
    inside = [False] * len(tokens)
    for a, b, _ in spans:
        a -= lang in DEPTH_LANGUAGES  # there the brace belongs to the block
        inside[max(a, 0) : b + 1] = [True] * (b + 1 - max(a, 0))
    ignored = ignored_mask(tokens, inside, ignore_lines(text, lang))
    inside = [x and not y for x, y in zip(inside, ignored)]
    pair = partners(tokens)
    tables = table_spans(tokens, lang, pair)
    logic = logic_mask(tokens, lang, inside)
    return Masks(inside, logic, imports(tokens, lang, inside), ignored, spans, tables, object_spans(tokens, lang, pair, logic), code_spans(tokens, lang, pair, spans, tables))


def table_at(m: Masks, pos: int, size: int) -> int:
    """Index of the table that holds all of these tokens and none of the code in it, or -1."""
    end = pos + size - 1
    if any(pos <= b and a <= end for a, b in m.code_in_tables):
        return -1
    return next((n for n, (a, b) in enumerate(m.tables) if a <= pos and end <= b), -1)
