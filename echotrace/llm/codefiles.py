"""Source files that nobody wrote by hand: generated, minified, vendored and data saved as code.

Linear support-vector classifiers on hashed character n-grams (of comments, and of the code with names, numbers and strings
masked), line shapes and path components, of three views of a file: the whole file for all kinds, and for the kinds that a banner tells, its
comments and each single line of them. There are no labels; the public marks below label the rows of a bounded sample. So that a classifier
learns the look of the code and the words around a mark and not only the mark, each marked row is also shown with its marks masked.
What a fit on the other repositories finds among the unmarked rows joins the positives of the next fit when it is clear, and is no
counter-example when it is in doubt. Folds and validation (p5_validation) are split by repository. Third-party source is recognised by where
it lies or by its banner; a copy of it elsewhere has neither, so files equal to a recognised one but for comments and blanks follow it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.skew import hot_keys, salted_lookup
from ..session import cut_lineage, table
from .linear import DIMS, Model, fit_svms, gram_ids, merged, scores, scores_of, word_ids

#: Most rows and most bytes of a training sample; rows are taken in the order of a hash of their id, those that don't fit are passed over.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 20
#: Of each view: the cost of a training error; the scores from which an unmarked row is no counter-example, and is a case; rounds of that;
#: the most that marked rows weigh against others.
VIEWS = {"file": (0.3, -0.5, 0.3, 3, 10.0), "header": (0.1, -0.6, 0.1, 12, 30.0), "line": (0.1, -0.8, -0.1, 12, 50.0)}
FOLDS = 2
KINDS = ("generated", "minified", "vendored", "data")
#: Kinds that a banner tells.
TOLD = ("generated", "vendored")

# Public marks of tools and third parties. They label training rows; they decide no file. At the start of a comment line:
GENERATED_MARKS = re.compile(
    r"^[^\w@<]*(?:"
    r"code generated\b.*\bdo not edit|generated code\b.*\bdo not (?:edit|modify)"  # Go's convention; Dart's build_runner
    r"|@generated\b|@autogenerated\b|<auto-?generated"  # Relay and many others; .NET
    r"|(?:this (?:file|code) (?:is|was) )?(?:automatically|auto-?) ?generated\b(?! banner)|(?:this (?:file|code) (?:is|was) )?generated by\b(?! call)"  # protoc, SWIG, ANTLR, Thrift
    r"|this code was (?:generated|produced) by a tool|changes to this file (?:may|will) .*\blost\b"  # .NET designers
    r"|automatisch (?:generiert|erzeugt)\b|(?:fichier )?généré automatiquement\b|generado automáticamente\b"  # the same in translation
    r")",
    re.M,
)
#: Line directives of parser generators (yacc, lex).
LINE_DIRECTIVE = re.compile(r'^\s*#line \d+ ".*\.[yl]"', re.M)
GENERATED_PATHS = re.compile(r"(_pb2(_grpc)?\.py|_pb\.\w+|_services_pb\.rb|\.pb(\.gw|-c)?\.\w+|\.(g|gen|generated)\.\w+|outerclass\.java|\.tab\.c)$")
GENERATED_PARTS = frozenset("gen generated autogen".split())
#: So many numbers in a row are a table that no hand wrote (parser tables and the like).
TABLE = re.compile(r"(?:-?\b9\b,\s*){60}")
MINIFIED_PATHS = re.compile(r"([.-]min|\.bundle|-[0-9a-f]{8,})\.(js|ts|css)$")
VENDORED_PARTS = frozenset("node_modules bower_components third_party thirdparty vendor godeps external deps ext jspm_packages".split())
VENDORED_MARKS = re.compile(
    r"^\W*(?:"
    r"@license\b|@preserve\b"  # comments that bundlers keep
    r"|upstream-(?:name|contact|version):"  # fields of Debian's machine-readable copyright files and of package metadata
    r"|vendored from\b"
    r"|this file is part of \w+|\w+ is free software[;:]"  # the GNU notice
    r"|(?:released|distributed|licensed) under the (?:mit|bsd|apache)\b"
    r"|copyright\b.*\b(?:contributors|authors)\b"  # "The Go Authors" and the like
    r")",
    re.M,
)

_LINES = re.compile(r"\r\n|\r|\n")
_COMMENT = re.compile(r"\s*(//|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|pragma|undef)\b)|/\*|\*(?:[\s/]|$)|--\s|<!--)")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_NUMBER = re.compile(r"\b0[xX][0-9a-fA-F]+\b|\b\d[\d.]*\b")
_KEYWORDS = (
    "if else for while do switch case return break continue func function def class import from package using namespace public private protected static "
    "final const let var void int long new try catch except finally raise throw with as in is not and or None nil null true false end then begin require "
    "export module struct enum interface type range yield lambda async await unless until exports self this"
)
_NAME = re.compile(r"\b(?!(?:" + "|".join(_KEYWORDS.split()) + r")\b)[A-Za-z_$][\w$]*")
_BLANK = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_HEX = re.compile(r"\b[0-9a-f]*\d[0-9a-f]{5,}\b")
_WORD = re.compile(r"[^\W\d_]{3,}")


def clean_path(path: str | None) -> str:
    """Lower case, forward slashes, no leading ./ ; null is the empty path."""
    p = (path or "").strip().lower().replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    return p


def split_source(text: str | None) -> tuple[str, list[str]]:
    """(comment text in lower case, code lines as written); null is an empty file."""
    comments, code = [], []
    for line in _LINES.split(text or ""):
        m = _COMMENT.match(line)
        if m:
            comments.append(line[m.start(1) :].strip())
        elif line.strip():
            code.append(line)
    return "\n".join(comments).lower(), code


def look(code: list[str]) -> tuple[str, float, int]:
    """Code with strings, numbers and names masked; the share of it that is no name; and how many different names there are."""
    body = "\n".join(code)
    plain = _NUMBER.sub("9", _STRING.sub('"', body))
    names = _NAME.findall(plain)
    return _NAME.sub("i", plain), 1.0 - sum(map(len, names)) / max(len("".join(body.split())), 1), len(set(names))


def features(path: str, comments: str, code: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features in blocks of unit length: file name, folders, comments, their words, code, and how far line shapes repeat; empty blocks are left out."""
    blocks = []
    if path:
        *dirs, name = path.split("/")
        name = _HEX.sub("h", _DIGITS.sub("9", name)) if not _HEX.search(name) else _HEX.sub("h", name)
        ext = name[name.find(".") :] if "." in name else ""
        stem_end = re.findall(r"[_.-][a-z0-9]+", name)
        blocks.append(word_ids(["x:" + ext, *("e:" + s for s in stem_end[-3:])]))
        known = VENDORED_PARTS | GENERATED_PARTS
        if dirs:
            blocks.append(word_ids({"d:" + d for d in dirs if d in known} | {"n:" + w for d in dirs if d not in known for w in _WORD.findall(d)}))
    if comments:
        text = _HEX.sub("h", _DIGITS.sub("9", comments))
        blocks.append(gram_ids(text, 5, 5))
        # A library or tool that is known from a folder is known in a banner.
        blocks.append(word_ids({"n:" + w for w in _WORD.findall(comments)}))
    if code:
        masked_code, share, names = look(code)
        lines = [" ".join(s.split()) for s in masked_code.split("\n")]
        uniq = set(lines)
        pairs = {f"b:{x}|{y}" for x, y in zip(lines, lines[1:])}
        blocks.append(np.concatenate([gram_ids("\n".join(sorted(uniq)), 4, 4), word_ids({"l:" + s for s in uniq} | pairs)]))
        runs = Counter(zip(lines, lines[1:], lines[2:]))
        held = [f"p:{int(10 * share)}", f"i:{min(int(np.log2(1 + names)), 9)}"]
        if runs:
            total = sum(runs.values())
            varied, most = int(10 * len(runs) / total), int(10 * max(runs.values()) / total)
            size = int(np.log2(total + 1))
            held += [f"v:{varied}", f"m:{most}", f"vm:{varied}:{most}", f"vn:{varied}:{size}", f"mn:{most}:{size}"]
        blocks.append(word_ids(held))
    if not blocks:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(blocks), np.concatenate([np.full(len(b), 1.0 / np.sqrt(max(1, len(b)))) for b in blocks])


def line_features(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams, words and pairs of words of one line of comment."""
    line = _HEX.sub("h", _DIGITS.sub("9", line))
    w = _WORD.findall(line)
    blocks = [b for b in (gram_ids(line, 5, 5), word_ids({"n:" + x for x in w}), word_ids({f"b:{x} {y}" for x, y in zip(w, w[1:])})) if len(b)]
    if not blocks:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(blocks), np.concatenate([np.full(len(b), 1.0 / np.sqrt(len(b))) for b in blocks])


def marked(path: str, comments: str, code: list[str]) -> dict[str, bool]:
    """Which kinds the public marks name."""
    body = "\n".join(code)
    longest = max((len(s) for s in code), default=0)
    dense = len(body) > 110 * len(code) and sum(map(str.isspace, _STRING.sub("", body))) < 0.06 * len(body)
    masked_code, share, names = look(code)
    few = names <= 8
    return {
        "generated": bool(
            GENERATED_MARKS.search(comments) or GENERATED_PATHS.search(path) or GENERATED_PARTS & set(path.split("/")[:-1])
            or LINE_DIRECTIVE.search(body) or LINE_DIRECTIVE.search(comments) or TABLE.search(masked_code) and "(" in body and not few
        ),
        "minified": longest > 150 and (bool(MINIFIED_PATHS.search(path)) or dense),
        "vendored": bool(VENDORED_PARTS & set(path.split("/")[:-1]) or VENDORED_MARKS.search(comments)),
        "data": len(body) > 400 and few and share > 0.7,
    }


def _masked_comments(comments: str, marks: re.Pattern) -> str:
    return "\n".join(c for c in comments.split("\n") if not marks.search(c))


def masked(path: str, comments: str, code: list[str]) -> tuple[str, str, list[str]]:
    """The row without comment lines, file endings and folders that are marks; its code is kept."""
    *dirs, name = path.split("/")
    for ends, plain in ((GENERATED_PATHS, lambda m: "." + m[0].rsplit(".", 1)[1]), (MINIFIED_PATHS, r".\2")):
        while ends.search(name):
            name = ends.sub(plain, name)
    dirs = [d for d in dirs if d not in GENERATED_PARTS | VENDORED_PARTS]
    return "/".join([*dirs, name]), _masked_comments(_masked_comments(comments, GENERATED_MARKS), VENDORED_MARKS), code


def _views(path: str, comments: str, code: list[str], kinds: dict[str, bool]):
    """The row as it is, and with the marks of its kind masked where something else tells its kind."""
    yield path, comments, code
    bare = "src/" + path.rsplit("/", 1)[-1]
    if kinds["generated"]:
        if GENERATED_MARKS.search(comments):
            yield bare, comments, []
            yield bare, GENERATED_MARKS.sub("", comments), []  # the words around the mark
        yield masked(path, comments, code)
    if kinds["minified"]:
        yield MINIFIED_PATHS.sub(r".\2", path), "", code
    if kinds["data"]:
        yield "", "", code
    if kinds["vendored"]:
        if VENDORED_PARTS & set(path.split("/")[:-1]):
            yield path, "", code
            yield "/".join(d for d in path.split("/")[:-1] if d not in VENDORED_PARTS) + "/x", "", []  # the library's name
        if VENDORED_MARKS.search(comments):
            yield bare, comments, code
            yield bare, VENDORED_MARKS.sub("", comments), []
        yield masked(path, comments, code)


def _rows(view: str, sample: pd.DataFrame):
    """Training rows of a view: (features, kinds marked, kinds it may teach, owner, whether it is shown as it is)."""
    for i, (path, text) in enumerate(zip(sample["file_path"], sample["src_text"])):
        path, (comments, code) = clean_path(path), split_source(text)
        kinds = marked(path, comments, code)
        if view == "file":
            for n, v in enumerate(_views(path, comments, code, kinds)):
                yield features(*v), [kinds[k] for k in KINDS], [True] * len(KINDS), i, n == 0
            continue
        look = line_features if view == "line" else lambda c: features("", c, [])
        for part in dict.fromkeys(comments.split("\n")) if view == "line" else [comments] if comments else []:
            marks = {"generated": GENERATED_MARKS, "vendored": VENDORED_MARKS}
            told = [bool(marks[k].search(part)) for k in TOLD]
            # What a path or the code tells says nothing of the comments. Whole headers teach with their marks masked only: who writes of such
            # banners uses their words too.
            yield look(part), told, [(t and view == "line") or (not t and not kinds[k]) for t, k in zip(told, TOLD)], i, True
            for n, k in enumerate(TOLD):
                if told[n] and _WORD.search(rest := marks[k].sub("", part)):
                    yield look(rest), told, [n == m for m in range(len(TOLD))], i, False
        dirs = path.split("/")[:-1]
        lies = next((n for n, d in enumerate(dirs) if d in VENDORED_PARTS), None)
        if lies is not None:  # the names of third parties
            name = [x for x in dirs[lies + 1 :] if x not in VENDORED_PARTS]
            yield (line_features(name[0]) if view == "line" and name else features("/".join(dirs) + "/x", "", [])), [False, True], [False, True], i, False


def train_view(view: str, sample: pd.DataFrame) -> Model:
    """The classifiers of one view from a sample with columns file_path, src_text and repo. An empty sample gives classifiers that find nothing."""
    cost, doubt_from, clear, rounds, most = VIEWS[view]
    shown = [(merged(f), *rest) for f, *rest in _rows(view, sample)]
    width = len(KINDS if view == "file" else TOLD)
    if not shown:
        return np.zeros((DIMS, width), dtype=np.float32), np.full(width, -1.0)
    rows = [r[0] for r in shown]
    marks, use, owner, first = (np.array([r[n] for r in shown]) for n in (1, 2, 3, 4))
    base = cost * (1.0 / np.bincount(owner)[owner])[:, None] * use
    fold = np.array([zlib.crc32(str(r).encode()) % FOLDS for r in sample["repo"]])[owner]
    found, doubt = np.zeros(marks.shape, dtype=bool), np.zeros(marks.shape, dtype=bool)

    def fit(weight, parts: int, epochs: int) -> Model:
        pos = marks | found
        c = base * np.where(pos, weight(pos), 1.0) * ~(doubt & ~pos)
        # All folds' machines at once: each learns from the other repositories.
        split = np.concatenate([c * (fold != f)[:, None] for f in range(parts)], axis=1) if parts > 1 else c
        return fit_svms(rows, np.tile(np.where(pos, 1.0, -1.0), parts), split, epochs)

    for _ in range(rounds):
        model = fit(lambda pos: np.minimum((~pos & use).sum(0) / np.maximum((pos & use).sum(0), 1), most), FOLDS, 4)
        at = np.flatnonzero(first)
        s = scores_of(model, [rows[i] for i in at]).reshape(len(at), FOLDS, width)[np.arange(len(at)), fold[at]]
        found[at], doubt[at] = (s > clear) & ~marks[at], s > doubt_from
    return fit(lambda pos: 2.0, 1, 6)


Models = dict[str, Model]


def train(spark: SparkSession, sample: pd.DataFrame) -> Models:
    """The classifiers of all views, each fitted in a task of its own on the broadcast sample, whose size is bounded."""
    sent = spark.sparkContext.broadcast(sample[["file_path", "src_text", "repo"]])

    def run(batches):
        for pdf in batches:
            for view in pdf["view"]:
                w, b = train_view(view, sent.value)
                yield pd.DataFrame({"view": [view], "w": [zlib.compress(w.tobytes(), 1)], "b": [b.astype("<f8").tobytes()]})

    views = spark.createDataFrame([(v,) for v in VIEWS], "view string").repartitionByRange(len(VIEWS), "view")
    out = {}
    for r in views.mapInPandas(run, "view string, w binary, b binary").collect():  # one row a view
        b = np.frombuffer(r.b, dtype="<f8")
        out[r.view] = np.frombuffer(zlib.decompress(r.w), dtype=np.float32).reshape(DIMS, len(b)), b
    return out


def judge(models: Models, path: str, comments: str, code: list[str]) -> np.ndarray:
    """The best score of each of KINDS over the views of a file."""
    best = scores(models["file"], features(path, comments, code))
    if comments:
        told = np.maximum(scores(models["header"], features("", comments, [])), np.max([scores(models["line"], line_features(c)) for c in set(comments.split("\n"))], axis=0))
        for n, k in enumerate(TOLD):
            best[KINDS.index(k)] = max(best[KINDS.index(k)], told[n])
    return best


def score_files(files: DataFrame, models) -> DataFrame:
    """(file_id, content, generated, minified, vendored, data): SVM scores of each row, and a hash of its code."""

    def run(batches):
        for pdf in batches:
            out = []
            for fid, path, text in zip(pdf["file_id"], pdf["file_path"], pdf["src_text"]):
                comments, code = split_source(text)
                packed = _BLANK.sub("", "".join(code)).encode("utf-8", "replace")
                out.append((fid, hashlib.sha256(packed).hexdigest() if packed else None, *judge(models.value, clean_path(path), comments, code).tolist()))
            yield pd.DataFrame(out, columns=["file_id", "content", *KINDS])

    return files.select("file_id", "file_path", "src_text").mapInPandas(run, "file_id int, content string, " + ", ".join(f"{k} double" for k in KINDS))


def with_repo(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Add `repo`, the repository of the file's run without case and blanks; the run itself where that is unknown."""
    repos = runs.where("run_id is not null").groupBy("run_id").agg(F.min(F.lower(F.trim("repo"))).alias("_repo"))
    own = files.join(repos, "run_id", "left")
    return own.withColumn("repo", F.coalesce("_repo", F.concat(F.lit("run "), F.col("run_id").cast("string")), F.lit(""))).drop("_repo")


def sample_of(files: DataFrame) -> pd.DataFrame:
    """At most SAMPLE_ROWS files and SAMPLE_BYTES of text, in the order of a hash of their id: ids and sizes first, then the texts."""
    sizes = files.groupBy("file_id").agg(F.max(F.coalesce(F.octet_length("src_text"), F.lit(0)) + F.coalesce(F.octet_length("file_path"), F.lit(0))).alias("n"), F.count(F.lit(1)).alias("rows"))
    ids = sizes.orderBy(F.xxhash64("file_id"), "file_id").limit(SAMPLE_ROWS).toPandas()
    fits, left = [], SAMPLE_BYTES
    for fid, n, rows in ids.itertuples(index=False):
        if n * rows <= left:
            fits.append(int(fid))
            left -= n * rows
    chosen = files.sparkSession.createDataFrame([(i,) for i in fits], "file_id int")
    rows = files.select("file_id", "file_path", "src_text", "repo").join(F.broadcast(chosen), "file_id", "left_semi")
    return rows.toPandas().sort_values(["file_id", "file_path"]).drop_duplicates("file_id").reset_index(drop=True)


def not_hand_written(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id, kind): each file found, with its best kind. Repeated rows count once; a null text is an empty file."""
    files = files.where("file_id is not null").select("file_id", "run_id", "file_path", "src_text")
    models = files.sparkSession.sparkContext.broadcast(train(files.sparkSession, sample_of(with_repo(files, runs))))
    scored = cut_lineage(score_files(files, models))
    best = F.greatest(*KINDS)
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.array_position(F.array(*KINDS), best).cast("int"))
    direct = scored.where(best > 0).select("file_id", kind.alias("kind"))
    third = scored.where("vendored > 0 and content is not null").select("content").distinct().withColumn("third", F.lit(True))
    rest = scored.where((best <= 0) & F.col("content").isNotNull()).select("file_id", "content")
    copies = salted_lookup(rest, third, "content", hot_keys(rest, "content", max(1, scored.count())), F.col("file_id"), "inner")
    return direct.union(copies.select("file_id", F.lit("vendored"))).groupBy("file_id").agg(F.min("kind").alias("kind"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_hand_written(table(spark, sf_dir, "tokenized_files"), table(spark, sf_dir, "detect_runs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file that is not hand-written."""
    return _found(spark, sf_dir).select("file_id")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each file that is not hand-written."""
    return _found(spark, sf_dir)


def p5_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind, on all files of repositories held out of training and with all marks masked: rows marked, found, and both."""
    files = with_repo(table(spark, sf_dir, "tokenized_files").where("file_id is not null"), table(spark, sf_dir, "detect_runs"))
    held = F.crc32(F.col("repo")) % 4 == 0
    models = spark.sparkContext.broadcast(train(spark, sample_of(files.where(~held))))

    def run(batches):
        for pdf in batches:
            out = []
            for fid, path, text in zip(pdf["file_id"], pdf["file_path"], pdf["src_text"]):
                p, (comments, code) = clean_path(path), split_source(text)
                kinds = marked(p, comments, code)
                found = judge(models.value, *masked(p, comments, code)) > 0
                out.append((fid, path, *(x for k, y in zip(KINDS, found) for x in (kinds[k], bool(y)))))
            yield pd.DataFrame(out, columns=["file_id", "file_path", *flags])

    flags = [f"{k}_{x}" for k in KINDS for x in ("marked", "found")]
    scored = files.where(held).select("file_id", "file_path", "src_text").mapInPandas(run, "file_id int, file_path string, " + ", ".join(f"{x} boolean" for x in flags))
    once = scored.groupBy("file_id").agg(F.min(F.struct("file_path", *flags)).alias("r")).select("r.*")  # a repeated file counts once
    rows = once.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_marked").alias("m"), F.col(f"{k}_found").alias("f")) for k in KINDS))).alias("x")).select("x.*")
    counts = rows.groupBy("kind").agg(*(F.count_if(F.expr(c)).cast("int").alias(n) for n, c in (("marked", "m"), ("found", "f"), ("both", "m and f"))))
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(counts, "kind", "left").na.fill(0)


QUERIES = {"p5_found": p5_found, "p5_kinds": p5_kinds, "p5_validation": p5_validation}
ORACLES: dict[str, str] = {}
