"""Lexing of 20 languages by one compiled pattern per language, and where functions and imports lie in the tokens.

Sources are lexed as bytes (decoded as latin-1), so every byte beyond ASCII outside strings and comments is an operator.
A token is (kind, text, original, line): keywords and operators keep their text; names, numbers and strings keep only
their kind for comparison, and their spelling in `original`. Nothing fails: unterminated literals end with their line or
the file. A text of null has no tokens; a language that isn't known is lexed with // and /* */ comments and no keywords.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from .keywords import FUNCTION_WORDS, IMPORT_MODIFIERS, IMPORT_WORDS, KEYWORDS, OPERATORS_2, OPERATORS_3, TRIPLE_QUOTES
from .languages import BY_NAME, Language

KEYWORD, NAME, NUMBER, STRING, OPERATOR = range(5)


class Token(NamedTuple):
    kind: int
    text: str
    orig: str
    line: int
    end_line: int


_UNKNOWN = Language("", (), ("//",), ("/*", "*/"))


@lru_cache(maxsize=None)
def _pattern(name: str) -> re.Pattern:
    lang = BY_NAME.get(name, _UNKNOWN)
    alts = [("blank", r"[ \t\r]+"), ("feed", r"\n")]
    if lang.block_comment:
        a, b = map(re.escape, lang.block_comment)
        alts.append(("block", rf"{a}(?s:.*?)(?:{b}|\Z)"))
    alts.append(("comment", "(?:" + "|".join(map(re.escape, lang.line_comments)) + r")[^\n]*"))
    if name in TRIPLE_QUOTES:
        alts.append(("triple", "|".join(rf"{q * 3}(?s:\\.|.)*?(?:{q * 3}|\Z)" for q in TRIPLE_QUOTES[name])))
    if name in ("ruby", "shell", "php"):
        alts.append(("here", r"<<<?[~-]? *[\"'`]?[A-Za-z_][A-Za-z0-9_]*[\"'`]?"))
    if name == "rust":
        alts.append(("life", r"'(?![^'\\\n]'|\\(?:u\{[0-9A-Fa-f_]*\}|x..|.)')"))
    if name == "csharp":
        alts.append(("verbatim", r'(?=[@$]*@)[@$]+"(?s:""|[^"])*(?:"|\Z)|\$+"(?:\\.|[^"\\\n])*"?'))
    alts.append(("string", r'"(?:\\(?s:.)|[^"\\\n])*"?' + r"|'(?:\\(?s:.)|[^'\\\n])*'?|`(?s:\\.|[^`\\])*`?"))
    alts += [("number", r"[0-9][0-9._a-fA-FxXoO]*"), ("name", r"[A-Za-z_][A-Za-z0-9_]*")]
    if name in ("javascript", "typescript"):
        alts.append(("regex", r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*"))
    alts.append(("op", "|".join(map(re.escape, OPERATORS_3 + OPERATORS_2)) + r"|(?s:.)"))
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in alts))


def _before_regex(tokens: list[Token]) -> bool:
    """Whether a slash may open a regular expression: not after a value."""
    if not tokens:
        return True
    t = tokens[-1]
    if t.kind == KEYWORD:
        return t.text not in ("this", "super", "true", "false", "null")
    return t.kind == OPERATOR and t.text not in (")", "]", "++", "--")


def _here_id(text: str, lang: str, src: str) -> str | None:
    """The terminator that a heredoc opener names, or None if it is something else."""
    m = re.fullmatch(r"<<(<?)([~-]?)( *)([\"'`]?)([A-Za-z_]\w*)[\"'`]?", text)
    if not m or (lang == "php") != bool(m[1]) or (m[3] and lang != "shell") or (m[2] == "~" and lang != "ruby") or (m[2] and lang == "php"):
        return None
    if lang == "ruby" and not (m[2] or m[4]) and not m[5][0].isupper():
        return None
    return m[5]


def lex(src: str | bytes | None, lang: str) -> list[Token]:
    if src is None:
        return []
    text = (src.encode("utf-8", "surrogateescape") if isinstance(src, str) else src).decode("latin-1")
    match, words, out, waiting, pos, line = _pattern(lang).match, KEYWORDS.get(lang, frozenset()), [], [], 0, 1
    new, add, size = tuple.__new__, out.append, len(text)
    while pos < size:
        m = match(text, pos)
        kind, s = m.lastgroup, m[0]
        if kind == "blank":
            pos = m.end()
            continue
        if kind == "name":
            add(new(Token, (KEYWORD, s, "", line, line) if s in words else (NAME, "", s, line, line)))
            pos = m.end()
            continue
        if kind == "regex" and not _before_regex(out):
            kind, s = "op", next((o for o in OPERATORS_2 if text.startswith(o, pos)), text[pos])
        if kind == "here":
            ident = _here_id(s, lang, text)
            if ident:
                waiting.append(ident)
            kind, s = "op", next((o for o in OPERATORS_3 + OPERATORS_2 if text.startswith(o, pos)), text[pos])
        last = line
        if kind == "op" or kind == "life":
            add(new(Token, (OPERATOR, s, "", line, line)))
        elif kind == "number":
            add(new(Token, (NUMBER, "", s, line, line)))
        elif kind == "feed":
            last = line + 1
        else:
            last = line + s.count("\n")
            if kind in ("string", "triple", "verbatim", "regex"):
                add(new(Token, (STRING, "", s, line, last)))
        pos, line = pos + len(s), last
        if kind == "feed" and waiting:
            ident, waiting = waiting[0], waiting[1:]
            end = re.compile(rf"^[ \t]*{re.escape(ident)}(?![A-Za-z0-9_])", re.M).search(text, pos)
            if end:
                body = text[pos : end.start()]
                add(Token(STRING, "", body, line, line + body.count("\n")))
                line += body.count("\n")
                pos = end.end()
    return out


def _is(t: Token, kind: int, *texts: str) -> bool:
    return t.kind == kind and t.text in texts


def close_of(tokens: list[Token], at: int, opening: str = "{", closing: str = "}") -> int:
    """Index of the bracket that closes the one at `at`; the last index if none does."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == OPERATOR:
            depth += (tokens[i].text == opening) - (tokens[i].text == closing)
            if depth == 0 and tokens[i].text == closing:
                return i
    return len(tokens) - 1


def _open_of(tokens: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, -1, -1):
        if tokens[i].kind == OPERATOR:
            depth += (tokens[i].text == ")") - (tokens[i].text == "(")
            if depth == 0:
                return i
    return -1


def _name_after(tokens: list[Token], at: int, lang: str) -> str:
    """The name that follows a function word, over a receiver in parentheses; dotted names are joined."""
    i = at + 1
    if lang == "go" and i < len(tokens) and _is(tokens[i], OPERATOR, "("):
        i = close_of(tokens, i, "(", ")") + 1
    parts = []
    while i < len(tokens) and tokens[i].kind == NAME:
        parts.append(tokens[i].orig)
        if i + 1 < len(tokens) and _is(tokens[i + 1], OPERATOR, ".", ":"):
            parts.append(tokens[i + 1].text)
            i += 2
        else:
            break
    return "".join(parts).rstrip(".:")


Span = tuple[int, int, str]
_CONTROL = frozenset("if for while switch catch with".split())


def _python(tokens: list[Token]) -> list[Span]:
    """Bodies from the colon of a def to the next def or class after a blank line, or to the end."""
    starts = [i for i, t in enumerate(tokens) if _is(t, KEYWORD, "def", "class") and not (i and _is(tokens[i - 1], KEYWORD, "async") and t.text == "def")]
    starts += [i for i in range(len(tokens) - 1) if _is(tokens[i], KEYWORD, "async") and _is(tokens[i + 1], KEYWORD, "def")]
    gaps = sorted(i for i in starts if i == 0 or tokens[i].line > tokens[i - 1].end_line + 1 and tokens[i].line > tokens[i - 1].line + 1)
    out, at = [], 0
    while at < len(tokens):
        d = at + 1 if _is(tokens[at], KEYWORD, "async") and at + 1 < len(tokens) else at
        colon = next((j for j in range(d, len(tokens)) if _is(tokens[j], OPERATOR, ":")), -1) if _is(tokens[d], KEYWORD, "def") else -1
        if colon < 0:
            at = d + 1
            continue
        stop = next((g for g in gaps if g > colon), len(tokens))
        if stop - 1 > colon:
            out.append((colon + 1, stop - 1, _name_after(tokens, d, "python")))
        at = stop
    return out


def _braces(tokens: list[Token], lang: str) -> list[Span]:
    """From the first brace after a function word to its match."""
    words, out, i = FUNCTION_WORDS.get(lang, set()), [], 0
    while i < len(tokens):
        t = tokens[i]
        named = _is(t, KEYWORD, *words)
        posix = lang == "shell" and t.kind == NAME and [x.text for x in tokens[i + 1 : i + 4]] == ["(", ")", "{"]
        if not (named or posix):
            i += 1
            continue
        j = next((j for j in range(i + 1, len(tokens)) if _is(tokens[j], OPERATOR, "{") or _is(tokens[j], KEYWORD, *words)), -1)
        if j < 0 or not _is(tokens[j], OPERATOR, "{"):
            i += 1
            continue
        end = close_of(tokens, j)
        name = t.orig if posix else _name_after(tokens, i, lang)
        if lang == "r" and i >= 2 and tokens[i - 2].kind == NAME:
            name = tokens[i - 2].orig
        out.append((j + 1, end - 1 if _is(tokens[end], OPERATOR, "}") else end, name))
        i += 1
    return [s for s in out if s[1] >= s[0]]


def _by_depth(tokens: list[Token]) -> list[Span]:
    """Every block opened at depth 0 or 1: functions and methods with their names, classes without one."""
    out, open_at, depth = [], [], 0
    for i, t in enumerate(tokens):
        if _is(t, OPERATOR, "{"):
            if depth <= 1:
                open_at.append((depth, i))
            depth += 1
        elif _is(t, OPERATOR, "}"):
            depth -= 1
            if open_at and open_at[-1][0] == depth:
                out.append((open_at.pop()[1], i - 1))
    out += [(i, len(tokens) - 1) for _, i in open_at]
    return sorted((i + 1, b, _name_before(tokens, i)) for i, b in out if b > i)


def _name_before(tokens: list[Token], brace: int) -> str:
    """The name before the parameter list whose body opens at a brace; a few names, words and commas may stand between."""
    k = brace - 1
    while k >= 0 and brace - k <= 8 and (tokens[k].kind in (NAME, KEYWORD) or _is(tokens[k], OPERATOR, ",")):
        k -= 1
    o = _open_of(tokens, k) if k >= 0 and _is(tokens[k], OPERATOR, ")") else 0
    return tokens[o - 1].orig if o > 0 and tokens[o - 1].kind == NAME else ""


def _js(tokens: list[Token]) -> list[Span]:
    """Arrow bodies, and blocks after a parameter list that is not a control statement's."""
    out, i = [], 0
    while i < len(tokens):
        if _is(tokens[i], OPERATOR, "{") and i:
            name, body, p = "", _is(tokens[i - 1], OPERATOR, "=>"), i - 1
            if body:
                p = i - 2
            else:
                while p > 0 and not (tokens[p].kind == OPERATOR and tokens[p].text in (")", ";", "{", "}", "=", ",")) and i - p < 12:
                    p -= 1
            if p >= 0 and _is(tokens[p], OPERATOR, ")") and (p == i - 1 or body or any(_is(x, OPERATOR, ":") for x in tokens[p + 1 : i])):
                o = _open_of(tokens, p)
                head = tokens[o - 1] if o > 0 else None
                body = body or head is None or not (head.kind == KEYWORD and head.text in _CONTROL)
                if head is not None and head.kind == NAME:
                    name = head.orig
                elif o >= 2:
                    k = o - 1 - (_is(tokens[o - 1], KEYWORD, "async", "function"))
                    if _is(tokens[k], OPERATOR, "=", ":") and tokens[k - 1].kind == NAME:
                        name = tokens[k - 1].orig
            if body:
                end = close_of(tokens, i)
                out.append((i + 1, end - 1 if _is(tokens[end], OPERATOR, "}") else end, name))
        i += 1
    return [s for s in out if s[1] >= s[0]]


_OPENS = {
    "lua": frozenset("function if do repeat".split()),
    "elixir": frozenset("do fn".split()),
    "ruby": frozenset("def class module begin case do if unless while until for".split()),
}
_CLOSES = {"lua": frozenset(("end", "until")), "elixir": frozenset(("end",)), "ruby": frozenset(("end",))}


def _ends(tokens: list[Token], lang: str) -> list[Span]:
    """From a function word to its end; words that open blocks nest. In Ruby a trailing if, unless, while or until opens nothing."""
    words, out, i = FUNCTION_WORDS[lang], [], 0
    while i < len(tokens):
        if not _is(tokens[i], KEYWORD, *words):
            i += 1
            continue
        depth, j, loop = (0 if lang == "elixir" else 1), i + 1, False
        while j < len(tokens):
            t = tokens[j]
            first = tokens[j - 1].line != t.line or (tokens[j - 1].kind == OPERATOR and tokens[j - 1].text in ("=", "(", ";"))
            if t.kind == KEYWORD and t.text in _OPENS[lang]:
                if lang == "ruby" and t.text in ("if", "unless", "while", "until") and not first:
                    pass
                elif lang == "ruby" and t.text == "do" and loop:
                    loop = False
                elif not (lang == "elixir" and t.text == "do" and j + 1 < len(tokens) and _is(tokens[j + 1], OPERATOR, ":")):
                    depth += 1
                    loop = lang == "ruby" and t.text in ("while", "until", "for")
            elif t.kind == KEYWORD and t.text in _CLOSES[lang]:
                depth -= 1
                if depth <= 0:
                    break
            j += 1
        stop = min(j, len(tokens)) - 1
        if stop > i + 1:
            out.append((i + 2, stop, _name_after(tokens, i, lang)))
        i = j + 1
    return [s for s in out if s[1] >= s[0]]


def _sql(tokens: list[Token]) -> list[Span]:
    out, i = [], 0
    while i < len(tokens):
        if _is(tokens[i], KEYWORD, *FUNCTION_WORDS["sql"]):
            b = next((j for j in range(i, len(tokens)) if _is(tokens[j], KEYWORD, "BEGIN", "begin")), -1)
            if b < 0:
                break
            depth, j = 1, b + 1
            while j < len(tokens) and depth:
                depth += _is(tokens[j], KEYWORD, "BEGIN", "begin", "CASE", "case") - _is(tokens[j], KEYWORD, "END", "end")
                j += 1
            if j - 2 > b:
                out.append((b + 1, j - 2, _name_after(tokens, i, "sql")))
            i = j
        else:
            i += 1
    return out


def functions(tokens: list[Token], lang: str) -> list[Span]:
    """(first token, last token, name) of each function body."""
    if lang == "python":
        return _python(tokens)
    if lang in ("javascript", "typescript"):
        return _js(tokens)
    if lang in _OPENS:
        return _ends(tokens, lang)
    if lang == "sql":
        return _sql(tokens)
    if lang in ("java", "c", "cpp", "csharp", "dart"):
        return _by_depth(tokens)
    return _braces(tokens, lang)


def _word(tokens: list[Token], i: int) -> str:
    return tokens[i].text + tokens[i].orig if i < len(tokens) else ""


def _imports_here(tokens: list[Token], k: int, lang: str) -> bool:
    """Whether the import word at k is one, and not code that begins alike."""
    word, nxt = _word(tokens, k), _word(tokens, k + 1)
    on_line = k + 1 < len(tokens) and tokens[k + 1].line == tokens[k].line
    block = any(_is(t, OPERATOR, "{") for t in tokens[k + 1 : next((j for j in range(k + 1, len(tokens)) if tokens[j].line != tokens[k].line), len(tokens))])
    rules = {
        ("c", "#"): nxt in ("include", "import", "pragma"), ("cpp", "#"): nxt in ("include", "import", "pragma"), ("cpp", "using"): nxt == "namespace",
        ("rust", "mod"): _word(tokens, k + 2) == ";", ("rust", "extern"): nxt == "crate",
        ("csharp", "namespace"): on_line and not block, ("php", "namespace"): not block,
        ("dart", "export"): on_line, ("dart", "part"): on_line, ("dart", "library"): on_line,
    }
    return rules.get((lang, word), True)


def imports(tokens: list[Token], lang: str, inside: list[bool]) -> list[bool]:
    """Which tokens belong to import statements outside functions: from the start of a line to its end, its semicolon, or the close of a bracket."""
    out = [False] * len(tokens)
    starters, i = IMPORT_WORDS.get(lang, frozenset()), 0
    while i < len(tokens):
        if inside[i] or (i and tokens[i - 1].line == tokens[i].line):
            i += 1
            continue
        k = i
        while k + 1 < len(tokens) and _word(tokens, k) in IMPORT_MODIFIERS and tokens[k + 1].line == tokens[i].line:
            k += 1
        if _word(tokens, k) not in starters or not _imports_here(tokens, k, lang):
            i += 1
            continue
        j, depth = i, 0
        while j < len(tokens) and not (j > i and depth == 0 and tokens[j].line != tokens[j - 1].line):
            out[j] = True
            if tokens[j].kind == OPERATOR:
                if tokens[j].text == ";" and depth == 0:
                    j += 1
                    break
                depth += (tokens[j].text in ("(", "{", "[")) - (tokens[j].text in (")", "}", "]"))
            j += 1
        i = j
    return out


def fnv64(parts) -> int:
    """FNV-1a over bytes."""
    h = 0xCBF29CE484222325
    for b in parts:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fingerprint(tokens, full: bool = False) -> str:
    """16 hex digits over kind, text (and spelling, if full) and a zero byte of each token."""
    data = bytearray()
    for t in tokens:
        data.append(t.kind)
        data += t.text.encode("latin-1")
        if full:
            data += t.orig.encode("latin-1")
        data.append(0)
    return f"{fnv64(data):016x}"
