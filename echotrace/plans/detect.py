"""Detection of copied code in source files: lexing, windows, the greedy sweep, and the clones it leaves.

Each file is lexed once, into a written table of window hashes, lines, spellings and spans; everything after reads arrays of it.
Relational steps (windows, repeated hashes, parts of the data that can't influence each other) are DataFrame operations;
lexing, and the sweep within such parts, are Arrow-batched Python. A sweep only ever marks positions of repeated
windows that it reaches through equal hashes or from the position before, so runs of adjacent repeated positions that share
no hash, directly or indirectly, are swept independently with the result of one sweep over everything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.languages import BY_EXTENSION
from ..functions.paths import slashed
from ..functions.rolling import spans_hash, windows_hash
from ..operators.labels import linked_by_keys, smallest_labels
from ..operators.matching import greedy_matching
from ..operators.skew import HOT_PARTS, salted_lookup, spread
from ..session import cut_lineage, table

#: Defaults of a scan (fixed values): window length, least lines of a clone, and the share of lines that makes a clone redundant.
MIN_TOKENS, MIN_LINES, OVERLAP = 50, 5, 0.6
#: Parts are swept together in so many groups for each shuffle partition.
SWEEPS = 4

_LEXED = (
    "file_id int, run_id int, path string, k int, n_tokens int, ignored int, win array<bigint>, line array<int>, end_line array<int>, full array<bigint>, norm binary, "
    "off array<int>, name_at array<int>, name array<string>, tables array<int>, code array<int>"
)


def language_of(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return BY_EXTENSION.get("." + name.rsplit(".", 1)[-1].lower(), "") if "." in name else ""


class _Symbols:
    """64-bit codes of tokens, alike in every worker."""

    def __init__(self):
        self.memo: dict = {}

    def __call__(self, *parts) -> int:
        if parts not in self.memo:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            self.memo[parts] = int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return self.memo[parts]


def lexed_row(text: str | None, lang: str, run_id: int | None, k: int, whole_file: bool, symbol: _Symbols) -> dict:
    """What detection keeps of one file. Names and literals are alike in executable code; outside it names count, and in tables literals too.

    With whole_file everything but imports and ignored functions is in scope, else only function bodies. A null text has no tokens.
    """
    from ..functions import lexer
    from ..functions.masks import masks

    tokens = lexer.lex(text, lang)
    m = masks(tokens, lang, text)
    exact = [False] * len(tokens)
    for a, b in (*m.tables, *m.objects):
        exact[a : b + 1] = [True] * (b + 1 - a)
    out = [x or y for x, y in zip(m.imports, m.ignored)] if whole_file else [not x for x in m.inside]
    loose = [symbol(t.kind, t.text) for t in tokens]
    full = [symbol(t.kind, t.text, t.orig) if t.orig else c for t, c in zip(tokens, loose)]
    if whole_file:
        # A strict code never equals a loose one.
        loose = [c if inner else symbol("strict", t.kind, t.text, t.orig if t.kind == lexer.NAME or e else "") for t, c, inner, e in zip(tokens, loose, m.logic, exact)]
    pieces = [bytes((t.kind,)) + t.text.encode("latin-1") + b"\0" for t in tokens]
    named = [x for x in m.spans if x[2]]
    return {
        "n_tokens": len(tokens), "ignored": sum(m.ignored), "win": windows_hash(np.array(loose, dtype=np.uint64), k, np.array(out, dtype=bool), 0 if run_id is None else run_id), "line": np.array([t.line for t in tokens], dtype=np.int32),
        "end_line": np.array([t.end_line for t in tokens], dtype=np.int32), "full": np.array(full, dtype=np.uint64).view(np.int64), "norm": b"".join(pieces),
        "off": np.cumsum([0, *map(len, pieces)]).astype(np.int32), "name_at": [i for a, b, _ in named for i in (a, b)], "name": [n for _, _, n in named],
        "tables": [i for x in m.tables for i in x], "code": [i for x in m.code_in_tables for i in x],
    }


def lex_files(files: DataFrame, whole_file: bool = True) -> DataFrame:
    """One row per file (file_id, run_id, path, text, k) with the columns of lexed_row: windows without scope have hash 0."""

    def run(batches):
        symbol = _Symbols()
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                rows = []
                for f, r, p, text, k in zip(part["file_id"], part["run_id"], part["path"], part["text"], part["k"]):
                    rows.append({"file_id": f, "run_id": r, "path": p, "k": k, **lexed_row(text, language_of(p), r, int(k), whole_file, symbol)})
                yield pd.DataFrame(rows)

    return spread(files.select("file_id", "run_id", "path", "text", "k"), "file_id").mapInPandas(run, _LEXED)


def repeated_windows(lexed: DataFrame) -> DataFrame:
    """(file_id, path, k, run_id, pos, h) of all windows whose content stands in two places of their run."""
    w = lexed.select("file_id", "path", "k", "run_id", F.posexplode("win").alias("pos", "h")).where("h <> 0")
    counts = cut_lineage(w.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(1, (total or 0) // HOT_PARTS)
    if (most or 0) <= limit:  # no hash is hot
        return w.join(counts.select("h"), "h")
    # Fewer than HOT_PARTS hashes can hold more than total/HOT_PARTS windows each.
    return salted_lookup(w, counts.select("h"), "h", counts.where(F.col("n") > limit).select("h"), F.xxhash64("file_id", "pos"), "inner")


def sweep(rows: pd.DataFrame) -> list[tuple[int, list[tuple[int, int]]]]:
    """(tokens, starts as (file, pos)) of the clones in some parts, in the order of discovery.

    Columns: file_id, pos, h, k, path, and `seen` if only clones with a file in scope are wanted. From the first uncovered position on: of the uncovered
    places of its hash, the first of each file if they are in two or more files, else those at least k apart; while all starts go on alike the
    clone grows; what it spans is covered. Each place is looked at a bounded number of times, whatever the size of its group.
    """
    key = rows["path"].fillna("").str.replace("/", "\0", regex=False) if "path" in rows else rows["file_id"].astype(str)
    order = rows.assign(_key=key).sort_values(["_key", "file_id", "pos"], kind="stable")
    file_of, pos, h = order["file_id"].tolist(), order["pos"].tolist(), order["h"].tolist()
    ks = order["k"].tolist()
    seen = order["seen"].tolist() if "seen" in order else None
    n = len(pos)
    follows = [i + 1 if i + 1 < n and file_of[i + 1] == file_of[i] and pos[i + 1] == pos[i] + 1 else -1 for i in range(n)]
    places: dict[int, list[int]] = {}
    for i, x in enumerate(h):
        places.setdefault(x, []).append(i)
    covered, out = bytearray(n), []
    for i in range(n):
        if covered[i]:
            continue
        k = ks[i]
        free = places[h[i]] = [q for q in places[h[i]] if not covered[q]]
        first = file_of[free[0]]
        if any(file_of[q] != first for q in free):
            starts = [q for j, q in enumerate(free) if j == 0 or file_of[q] != file_of[free[j - 1]]]
        else:
            starts, last = [], None
            for q in free:
                if last is None or pos[q] >= last + k:
                    starts.append(q)
                    last = pos[q]
        if len(starts) < 2:
            continue
        if seen and not any(seen[q] for q in starts):
            for q in starts:
                covered[q] = 1
            continue
        ends, more = list(starts), 0
        while True:
            nxt = [follows[q] for q in ends]
            if -1 in nxt or len({h[q] for q in nxt}) != 1:
                break
            ends, more = nxt, more + 1
        for q in starts:
            for d in range(more + 1):
                covered[q + d] = 1
        size, kept, end = k + more, [], {}
        for q in starts:
            if pos[q] >= end.get(file_of[q], 0):
                kept.append((file_of[q], pos[q]))
                end[file_of[q]] = pos[q] + size
        if len(kept) > 1:
            out.append((size, kept))
    return out


_PLACES = "run_id int, clone string, no int, file_id int, pos int, size int"


def swept(rep: DataFrame, in_scope: DataFrame | None = None) -> DataFrame:
    """(run_id, clone, no, file_id, pos, size): the places of each clone. `in_scope` holds the file_ids of which a clone must touch one."""
    by = Window.partitionBy("file_id").orderBy("pos")
    # A run of adjacent positions has one number in its file.
    runs = cut_lineage(rep.withColumn("node", F.shiftleft(F.col("file_id").cast("bigint"), 32) + F.col("pos") - F.row_number().over(by) + 1))
    labels = linked_by_keys(runs.select("node", "h"), "node", "h")
    rows = runs.join(labels, "node")
    if in_scope is not None:
        rows = rows.join(in_scope.select("file_id", F.lit(True).alias("seen")).distinct(), "file_id", "left").na.fill({"seen": False})
    groups = SWEEPS * int(rep.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["run_id", "file_id", "path", "pos", "h", "k", *(["seen"] if in_scope is not None else [])]

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        run_of = dict(zip(pdf["file_id"], pdf["run_id"]))
        found = [(run_of[starts[0][0]], f"{starts[0][0]}:{starts[0][1]}", i, f, x, size) for size, starts in sweep(pdf) for i, (f, x) in enumerate(starts)]
        return pd.DataFrame(found, columns=["run_id", "clone", "no", "file_id", "pos", "size"])

    return rows.select(*columns, F.pmod(F.xxhash64("label"), F.lit(groups)).alias("part")).groupBy("part").applyInPandas(per_group, _PLACES)


def function_at(names: list[str], at: list[int], pos: int, end: int) -> str:
    """The innermost named function that the tokens begin in, else the one they overlap most."""
    spans = [(at[2 * i], at[2 * i + 1], n) for i, n in enumerate(names)]
    around = [x for x in spans if x[0] <= pos <= x[1]]
    if around:
        return max(around)[2]
    best = max(((min(end, b) - max(pos, a) + 1, -n, name) for n, (a, b, name) in enumerate(spans)), default=(0, 0, ""))
    return best[2] if best[0] > 0 else ""


_INSTANCES = "run_id int, clone string, no int, file_id int, path string, start_line int, end_line int, function string, hash string, full bigint, in_table int, size int"


def instances_of(places: DataFrame, lexed: DataFrame) -> DataFrame:
    """Lines, function, fingerprint (of a clone's first place), spelling and table of each place."""
    per_file = places.groupBy("file_id").agg(F.collect_list(F.struct("run_id", "clone", "no", "pos", "size")).alias("at"))
    found = spread(per_file.join(lexed.select("file_id", "path", "line", "end_line", "full", "norm", "off", "name_at", "name", "tables", "code"), "file_id"), "file_id")

    def run(batches):
        from ..functions.lexer import fnv64

        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                lines, ends, off = f.line, f.end_line, f.off
                tables, code = np.asarray(f.tables).reshape(-1, 2), np.asarray(f.code).reshape(-1, 2)
                size = np.array([p["size"] for p in f.at])
                start = np.array([p["pos"] for p in f.at])
                full = spans_hash(np.asarray(f.full).view(np.uint64), start, size)
                for p, h in zip(f.at, full.tolist()):
                    a, b = p["pos"], p["pos"] + p["size"] - 1
                    within = np.flatnonzero((tables[:, 0] <= a) & (b <= tables[:, 1])) if len(tables) and not ((code[:, 0] <= b) & (a <= code[:, 1])).any() else ()
                    stamp = f"{fnv64(f.norm[off[a] : off[b + 1]]):016x}" if p["no"] == 0 else None
                    rows.append((p["run_id"], p["clone"], p["no"], f.file_id, f.path, int(lines[a]), int(ends[b]), function_at(list(f.name), list(f.name_at), a, b), stamp, h, int(within[0]) if len(within) else -1, p["size"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _INSTANCES.split(", ")])

    return found.mapInPandas(run, _INSTANCES)


def exact_instances(files: DataFrame, whole_file: bool = True, in_scope: DataFrame | None = None) -> DataFrame:
    """The places of all clones, one row each, with their clone's hash, type, tokens and lines; tables that match their own rows are no clones."""
    lexed = cut_lineage(lex_files(files, whole_file))
    places = cut_lineage(swept(repeated_windows(lexed), in_scope))
    inst = cut_lineage(instances_of(places, lexed))
    head = F.min_by(F.struct("hash", (F.col("end_line") - F.col("start_line") + 1).alias("line_count")), "no")
    one = inst.groupBy("run_id", "clone").agg(
        head.alias("head"), F.when(F.min("full") == F.max("full"), "type-1").otherwise("type-2").alias("clone_type"), F.max("size").alias("token_count"), F.count(F.lit(1)).alias("n_instances"),
        ((F.min("in_table") >= 0) & (F.min("in_table") == F.max("in_table")) & (F.min("file_id") == F.max("file_id"))).alias("own_rows"),
    )
    one = one.where(~F.col("own_rows")).select("run_id", "clone", "head.*", "clone_type", "token_count", "n_instances")
    return inst.drop("hash", "full", "in_table", "size").join(one, ["run_id", "clone"])


def with_instances(rows: DataFrame) -> DataFrame:
    """One row per clone, its places in an array in order: what a report of it has to hold."""
    each = F.struct("no", "file_id", "path", "start_line", "end_line", "function")
    g = rows.groupBy("run_id", "clone").agg(*(F.first(c).alias(c) for c in ("hash", "clone_type", "token_count", "line_count")), F.array_sort(F.collect_list(each)).alias("i"))
    return g.select(
        "run_id", "clone", "hash", "clone_type", "token_count", "line_count",
        F.transform("i", lambda x: F.struct(*(x[c].alias(c) for c in ("file_id", "path", "start_line", "end_line", "function")))).alias("instances"),
    )


def exact_clones(files: DataFrame, whole_file: bool = True, in_scope: DataFrame | None = None) -> DataFrame:
    """(run_id, clone, hash, clone_type, token_count, line_count, instances) of the copies in files (file_id, run_id, path, text, k).

    `clone` numbers nothing: it is the first place (file and token) of the clone. Files of different runs are never compared.
    """
    return with_instances(exact_instances(files, whole_file, in_scope))


def dedup_overlapping(clones: DataFrame, key: str, share: float = OVERLAP) -> DataFrame:
    """Drop a clone when a single larger one that is kept covers `share` of the lines of each of its instances.

    Columns: `key`, hash, line_count, instances (file_id, start_line, end_line). Larger is (line_count desc, hash, key).
    Only clones that overlap in a file influence each other, so each connected set of those is judged by itself.
    """
    i = clones.select(key, F.explode("instances").alias("i")).select(key, F.col("i.file_id").alias("f"), F.col("i.start_line").alias("lo"), F.col("i.end_line").alias("hi"))
    reach = F.max("hi").over(Window.partitionBy("f").orderBy("lo", "hi", key).rowsBetween(Window.unboundedPreceding, -1))
    chained = i.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(Window.partitionBy("f").orderBy("lo", "hi", key)))
    labels = linked_by_keys(chained.select(F.xxhash64(key).alias("_id"), F.xxhash64("f", "g").alias("h")), "_id", "h")
    groups = SWEEPS * int(clones.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = clones.withColumn("_id", F.xxhash64(key)).join(labels, "_id").select(key, "hash", "line_count", "instances", F.pmod(F.xxhash64("label"), F.lit(groups)).alias("label"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, by_file = [], {}
        for r in pdf.sort_values(["line_count", "hash", key], ascending=[False, True, True]).to_dict("records"):
            inst = [(x["file_id"], x["start_line"], x["end_line"]) for x in r["instances"]]
            cover = None
            for f, a, b in inst:
                hit = {n for n, c, d in by_file.get(f, []) if min(b, d) - max(a, c) + 1 >= share * (b - a + 1)}
                cover = hit if cover is None else cover & hit
                if not cover:
                    break
            if not cover:
                for f, a, b in inst:
                    by_file.setdefault(f, []).append((len(kept), a, b))
                kept.append(r[key])
        return pd.DataFrame({key: kept})

    keep = part.groupBy("label").applyInPandas(judge, f"{key} {dict(clones.dtypes)[key]}")
    return clones.join(keep, key, "left_semi")


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file of the tables once, with its run's window length."""
    k = table(spark, sf_dir, "detect_runs").where("run_id is not null").groupBy("run_id").agg(F.coalesce(F.nullif(F.max("min_tokens"), F.lit(0)), F.lit(MIN_TOKENS)).alias("k"))
    f = table(spark, sf_dir, "tokenized_files").groupBy("file_id").agg(F.min("run_id").alias("run_id"), F.min(F.lower(slashed(F.col("file_path")))).alias("path"), F.min("src_text").alias("text"))
    return f.join(k, "run_id", "left").select("file_id", "run_id", "path", "text", F.coalesce("k", F.lit(MIN_TOKENS)).alias("k"))


def detect_exact_clones(spark, sf_dir):
    """The copies in every run's files, after dropping those that a larger one covers and those under MIN_LINES lines."""
    c = cut_lineage(exact_clones(run_files(spark, sf_dir)).withColumn("key", F.concat_ws("/", "run_id", "clone")))
    return dedup_overlapping(c, "key").where(F.col("line_count") >= MIN_LINES).select("run_id", "clone", "hash", "clone_type", "token_count", "line_count", F.size("instances").alias("n_instances"))


def token_rows(files: DataFrame) -> DataFrame:
    """(file_id, pos, kind, text, line, end_line): every token of files (file_id, path, text), spelled as in the file; kind is keyword, name, number, string or operator."""
    from ..functions import lexer

    kinds = ("keyword", "name", "number", "string", "operator")

    def run(batches):
        for pdf in batches:
            for f, p, text in zip(pdf["file_id"], pdf["path"], pdf["text"]):
                t = lexer.lex(text, language_of(p))
                spelled = [(x.text + x.orig).encode("latin-1").decode("utf-8", "replace") for x in t]
                yield pd.DataFrame({"file_id": f, "pos": range(len(t)), "kind": [kinds[x.kind] for x in t], "text": spelled, "line": [x.line for x in t], "end_line": [x.end_line for x in t]})

    return spread(files.select("file_id", "path", "text"), "file_id").mapInPandas(run, "file_id int, pos int, kind string, text string, line int, end_line int")


def register_functions(spark: SparkSession) -> None:
    """SQL functions: lex_source(text, language) as a table function with a row per token, and fnv64(text) as 16 hex digits."""
    from pyspark.sql.functions import pandas_udf, udtf

    @udtf(returnType="pos int, kind int, text string, orig string, line int, end_line int")
    class LexSource:
        def eval(self, text: str, language: str):
            from echotrace.functions import lexer

            for n, t in enumerate(lexer.lex(text, language or "")):
                yield n, t.kind, t.text, t.orig.encode("latin-1").decode("utf-8", "replace"), t.line, t.end_line

    @pandas_udf("string")
    def fnv64(texts: pd.Series) -> pd.Series:
        from echotrace.functions import lexer

        return pd.Series([None if t is None else f"{lexer.fnv64(t.encode('utf-8')):016x}" for t in texts], dtype=object)

    spark.udtf.register("lex_source", LexSource)
    spark.udf.register("fnv64", fnv64)


def lex_tokens(spark, sf_dir):
    """Per file: a hash of its tokens' spellings one after the other, and their number (not in Ruby, where the table cuts 3.times otherwise). Files without ready tokens are left out."""
    lexed = table(spark, sf_dir, "tokenized_files").groupBy("file_id").agg(F.max("tokens").isNotNull().alias("ok")).where("ok").select("file_id")
    t = token_rows(run_files(spark, sf_dir).join(lexed, "file_id", "left_semi"))
    # A file's tokens are no more than the file itself, so they may stand in one row.
    one = t.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"), F.count(F.lit(1)).alias("n"))
    paths = run_files(spark, sf_dir).join(lexed, "file_id", "left_semi").select("file_id", "path")
    spelling = F.md5(F.coalesce(F.array_join(F.transform("t", lambda x: x["text"]), ""), F.lit("")))
    return paths.join(one, "file_id", "left").select("file_id", spelling.alias("spelling"), F.when(~F.coalesce("path", F.lit("")).endswith(".rb"), F.coalesce("n", F.lit(0))).alias("n_tokens"))


def mask_rows(files: DataFrame) -> DataFrame:
    """(file_id, language, named_functions, import_lines, logic_tokens, tables) of files (file_id, path, text): what the masks find."""
    from ..functions import lexer
    from ..functions.masks import masks

    def run(batches):
        for pdf in batches:
            rows = []
            for f, p, text in zip(pdf["file_id"], pdf["path"], pdf["text"]):
                lang = language_of(p)
                t = lexer.lex(text, lang)
                m = masks(t, lang, text)
                rows.append((f, lang, sum(bool(n) for _, _, n in m.spans), len({x.line for x, i in zip(t, m.imports) if i}), sum(m.logic), len(m.tables)))
            yield pd.DataFrame(rows, columns=["file_id", "language", "named_functions", "import_lines", "logic_tokens", "tables"])

    return spread(files.select("file_id", "path", "text"), "file_id").mapInPandas(run, "file_id int, language string, named_functions int, import_lines int, logic_tokens int, tables int")


def _with_tokens(spark, sf_dir) -> DataFrame:
    ready = table(spark, sf_dir, "tokenized_files").groupBy("file_id").agg(F.max("tokens").isNotNull().alias("ok")).where("ok").select("file_id")
    return run_files(spark, sf_dir).join(ready, "file_id", "left_semi")


def function_counts(spark, sf_dir):
    """Named functions of each Go, JavaScript, Python and TypeScript file."""
    return mask_rows(_with_tokens(spark, sf_dir)).where("language in ('go', 'javascript', 'python', 'typescript')").select("file_id", "named_functions")


def import_line_counts(spark, sf_dir):
    """Lines of import statements outside functions of each TypeScript, Java, Ruby, C and C# file."""
    return mask_rows(_with_tokens(spark, sf_dir)).where("language in ('typescript', 'java', 'ruby', 'c', 'csharp')").select("file_id", "import_lines")


def covered_by_exact_copies(spark, sf_dir):
    """Per run and file: positions that begin a window of the run's length which stands, spelling and all, in another place of the run; of the ready tokens."""
    k = table(spark, sf_dir, "detect_runs").where("run_id is not null").groupBy("run_id").agg(F.coalesce(F.nullif(F.max("min_tokens"), F.lit(0)), F.lit(MIN_TOKENS)).alias("k"))
    f = table(spark, sf_dir, "tokenized_files").groupBy("file_id").agg(F.min("run_id").alias("run_id"), F.max("tokens").alias("tokens")).join(k, "run_id", "left").select("file_id", "run_id", F.coalesce("k", F.lit(MIN_TOKENS)).alias("k"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("codes"))

    def run(batches):
        for pdf in batches:
            for fid, rid, size, codes in zip(pdf["file_id"], pdf["run_id"], pdf["k"], pdf["codes"]):
                if codes is not None and len(codes) >= size:
                    c = np.asarray(codes).astype(np.int64).view(np.uint64)
                    yield pd.DataFrame({"file_id": fid, "run_id": rid, "path": "", "k": size, "win": [windows_hash(c, int(size), np.zeros(len(c), dtype=bool), int(rid))]})

    w = spread(f.where("run_id is not null"), "file_id").mapInPandas(run, "file_id int, run_id int, path string, k int, win array<bigint>")
    return repeated_windows(cut_lineage(w)).groupBy("run_id", "file_id").agg(F.count(F.lit(1)).alias("repeated_windows"))


def detect_functions(spark, sf_dir):
    """Functions per language and how many tokens lie in them."""
    from ..functions import lexer

    def run(batches):
        for pdf in batches:
            rows = []
            for p, text in zip(pdf["path"], pdf["text"]):
                lang = language_of(p)
                t = lexer.lex(text, lang)
                b = lexer.functions(t, lang)
                rows.append((lang, len(t), len(b), sum(y - x + 1 for x, y, _ in b)))
            yield pd.DataFrame(rows, columns=["language", "tokens", "functions", "body_tokens"]).groupby("language", as_index=False).sum()

    one = run_files(spark, sf_dir).mapInPandas(run, "language string, tokens bigint, functions bigint, body_tokens bigint")
    return one.groupBy("language").agg(*(F.sum(c).alias(c) for c in ("tokens", "functions", "body_tokens")))


def fuzzy_matching(spark, sf_dir):
    """Disjoint pairs of instances, the most similar first."""
    m = table(spark, sf_dir, "fuzzy_matches").select(F.col("a_idx").alias("a"), F.col("b_idx").alias("b"), F.col("similarity").alias("score"))
    return greedy_matching(m)


def dedup_overlap(spark, sf_dir):
    """Reported clones that no larger one makes redundant."""
    from .clones import clone_rows

    c = clone_rows(spark, sf_dir).where("clone_hash is not null and line_count is not null")
    inst = F.transform(F.filter("instances", lambda x: x["file_path"].isNotNull() & x["start_line"].isNotNull() & x["end_line"].isNotNull()), lambda x: F.struct(x["file_path"].alias("file_id"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line")))
    return dedup_overlapping(c.select("clone_id", F.col("clone_hash").alias("hash"), "line_count", inst.alias("instances")).where(F.size("instances") > 0), "clone_id").select("clone_id", "line_count")


QUERIES = {f.__name__: f for f in (detect_exact_clones, detect_functions, lex_tokens, function_counts, import_line_counts, covered_by_exact_copies, fuzzy_matching, dedup_overlap)}
_EXT = "regexp_extract(lower(replace(path, '\\', '/')), '\\.([a-z]+)$', 1)"
ORACLES: dict[str, str] = {
    "function_counts": f"""WITH f AS (SELECT file_id, min(file_path) AS path, any_value(tokens) AS t FROM tokenized_files WHERE tokens IS NOT NULL GROUP BY 1)
      SELECT file_id, CAST(len(list_filter(t, lambda x: x = CASE {_EXT} WHEN 'go' THEN 'func' WHEN 'py' THEN 'def' ELSE 'function' END)) AS INTEGER) AS named_functions FROM f WHERE {_EXT} IN ('go', 'py', 'js', 'ts')""",
    "import_line_counts": f"""WITH f AS (SELECT file_id, min(file_path) AS path, min(src_text) AS t FROM tokenized_files WHERE tokens IS NOT NULL GROUP BY 1)
      SELECT file_id, CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, CASE {_EXT} WHEN 'ts' THEN '^import ' WHEN 'java' THEN '^(import|package) ' WHEN 'rb' THEN '^require(_relative)? ' WHEN 'c' THEN '^#include' ELSE '^using ' END))) AS INTEGER) AS import_lines
      FROM f WHERE {_EXT} IN ('ts', 'java', 'rb', 'c', 'cs')""",
    # The pass itself, pair by pair: a pair is taken when neither end stands in the list of used ones.
    "fuzzy_matching": """WITH RECURSIVE m AS (SELECT least(a_idx, b_idx) AS a, greatest(a_idx, b_idx) AS b, max(similarity) AS score FROM fuzzy_matches WHERE a_idx <> b_idx AND similarity IS NOT NULL GROUP BY 1, 2),
      p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS n FROM m),
      r(n, a, b, score, taken, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), false, CAST([] AS BIGINT[])
        UNION ALL SELECT p.n, p.a, p.b, p.score, NOT (list_contains(used, p.a) OR list_contains(used, p.b)), CASE WHEN list_contains(used, p.a) OR list_contains(used, p.b) THEN used ELSE used || [p.a, p.b] END FROM r JOIN p ON p.n = r.n + 1)
      SELECT a, b, score FROM r WHERE taken""",
    # Clones in order, each dropped when one of the kept covers it; which cover which is known beforehand.
    "dedup_overlap": f"""WITH RECURSIVE c0 AS (SELECT DISTINCT ON (clone_id) clone_id, clone_hash, line_count, list_distinct(list_filter(coalesce(instances, []), lambda x: x IS NOT NULL AND x.instance_id IS NOT NULL)) AS i FROM clones WHERE clone_id IS NOT NULL),
      c1 AS (SELECT clone_id, clone_hash, line_count, list_filter(i, lambda x: x.file_path IS NOT NULL AND x.start_line IS NOT NULL AND x.end_line IS NOT NULL) AS i FROM c0 WHERE clone_hash IS NOT NULL AND line_count IS NOT NULL),
      c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY line_count DESC, clone_hash, clone_id) AS n FROM c1 WHERE len(i) > 0),
      x AS (SELECT n, clone_id, line_count, unnest(i) AS j, generate_subscripts(i, 1) AS no FROM c),
      o AS (SELECT DISTINCT s.n, s.no, l.n AS big FROM x s JOIN x l ON s.j.file_path = l.j.file_path AND l.n < s.n
        AND least(s.j.end_line, l.j.end_line) - greatest(s.j.start_line, l.j.start_line) + 1 >= {OVERLAP} * (s.j.end_line - s.j.start_line + 1)),
      b AS (SELECT n, big, count(*) AS k FROM o GROUP BY 1, 2), d AS MATERIALIZED (SELECT c.n, clone_id, line_count, coalesce(list(b.big) FILTER (b.big IS NOT NULL), []) AS covers FROM c LEFT JOIN b ON b.n = c.n AND b.k = len(c.i) GROUP BY 1, 2, 3),
      r(n, clone_id, line_count, keep, kept) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), false, CAST([] AS BIGINT[])
        UNION ALL SELECT d.n, d.clone_id, d.line_count, NOT list_has_any(kept, covers), CASE WHEN list_has_any(kept, covers) THEN kept ELSE kept || [d.n] END FROM r JOIN d ON d.n = r.n + 1)
      SELECT clone_id, line_count FROM r WHERE keep""",
    "lex_tokens": """SELECT file_id, md5(array_to_string(any_value(tokens), '')) AS spelling, CASE WHEN coalesce(min(lower(file_path)), '') NOT LIKE '%.rb' THEN CAST(len(any_value(tokens)) AS BIGINT) END AS n_tokens
      FROM tokenized_files WHERE tokens IS NOT NULL GROUP BY 1""",
    "covered_by_exact_copies": f"""WITH r AS (SELECT run_id, coalesce(nullif(max(min_tokens), 0), {MIN_TOKENS}) AS k FROM detect_runs GROUP BY 1),
      f AS (SELECT file_id, min(run_id) AS run_id, any_value(tokens) AS t FROM tokenized_files WHERE tokens IS NOT NULL GROUP BY 1),
      g AS (SELECT f.*, coalesce(k, {MIN_TOKENS}) AS k FROM f LEFT JOIN r USING (run_id) WHERE run_id IS NOT NULL),
      p AS (SELECT *, unnest(range(0, len(t) - k + 1)) AS pos FROM g WHERE len(t) >= k), w AS (SELECT run_id, file_id, md5(array_to_string(t[pos + 1 : pos + k], chr(1))) AS h FROM p),
      n AS (SELECT *, count(*) OVER (PARTITION BY run_id, h) AS n FROM w)
      SELECT run_id, file_id, count(*) AS repeated_windows FROM n WHERE n > 1 GROUP BY 1, 2""",
}
