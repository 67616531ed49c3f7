"""Near-miss (type-3) clones of a scan: blocks inside functions, their sets of small windows, and a greedy matching.

The pairs are found through an inverted index. A scan promises two caps, and reports when either took effect: postings of more than max_bucket
blocks are cut to the lowest, and no block is begun once max_pairs pairs are evaluated. Without caps (0) all pairs are found. A scan of one
tree is meant; for whole tables of blocks see p4.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.matching import greedy_matching
from ..operators.skew import HOT_PARTS, prefix_sums, salted_lookup, spread, top_within
from ..session import cut_lineage
from .detect import language_of

#: Defaults of a scan (fixed values).
SIMILARITY, MAX_BUCKET, MAX_PAIRS, LEAST_TOKENS = 0.70, 5000, 50_000_000, 10
#: What one entry of the index is taken to need, in bytes.
ENTRY_BYTES = 32


@dataclass
class Completeness:
    """What kept type-3 detection from comparing all pairs. Exact clones are always complete."""

    capped_pairs: bool = False
    bucket_truncated: bool = False
    memory_limited: bool = False
    evaluated: int = 0

    @property
    def partial(self) -> bool:
        return self.capped_pairs or self.bucket_truncated or self.memory_limited

    @property
    def reason(self) -> str:
        if self.memory_limited:
            return "type-3 detection was skipped, as its index would not fit in --max-memory; type-1 and type-2 clones are complete"
        caps = [n for n, hit in (("--max-pairs", self.capped_pairs), ("--max-bucket", self.bucket_truncated)) if hit]
        return f"type-3 detection was cut short by {' and '.join(caps)}; type-1 and type-2 clones are complete" if caps else ""

    def add(self, other: "Completeness") -> None:
        self.capped_pairs |= other.capped_pairs
        self.bucket_truncated |= other.bucket_truncated
        self.memory_limited |= other.memory_limited
        self.evaluated += other.evaluated

_BLOCK = "run_id int, file_id int, path string, pos int, k int, minis array<bigint>, full string, start_line int, end_line int, function string, in_table int"


def mini_width(k: int) -> int:
    """Tokens of a small window: a third of the window, rounded up, and at least 2."""
    return max(-(-k // 3), 2)


def blocks_of(files: DataFrame) -> DataFrame:
    """Every k tokens that lie in function bodies, with the distinct hashes of the small windows in them, spelling included."""
    from ..functions import lexer
    from ..functions.masks import masks, table_at
    from .detect import function_at

    def run(batches):
        for pdf in batches:
            rows = []
            for r, f, p, text, k in zip(pdf["run_id"], pdf["file_id"], pdf["path"], pdf["text"], pdf["k"]):
                lang = language_of(p)
                tokens = lexer.lex(text, lang)
                mask = masks(tokens, lang, text)
                inside = mask.inside
                named = [x for x in mask.spans if x[2]]
                at, names = [i for a, b, _ in named for i in (a, b)], [n for _, _, n in named]
                m, run_len = mini_width(k), 0
                minis = [int(lexer.fingerprint(tokens[i : i + m], True), 16) for i in range(len(tokens) - m + 1)]
                for i in range(len(tokens)):
                    run_len = run_len + 1 if inside[i] else 0
                    if run_len >= k:
                        s = i - k + 1
                        own = sorted({h - (1 << 64) if h >> 63 else h for h in minis[s : s + k - m + 1]})
                        rows.append((r, f, p, s, k, own, lexer.fingerprint(tokens[s : i + 1], True), tokens[s].line, tokens[i].end_line, function_at(names, at, s, i), table_at(mask, s, k)))
            yield pd.DataFrame(rows, columns=["run_id", "file_id", "path", "pos", "k", "minis", "full", "start_line", "end_line", "function", "in_table"])

    return spread(files.select("run_id", "file_id", "path", "text", "k"), "file_id").mapInPandas(run, _BLOCK)


def fuzzy_clones(files: DataFrame, exact: DataFrame | None = None, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """fuzzy_detection without a budget of pairs, and without its Completeness."""
    return fuzzy_detection(files, exact, similarity, max_bucket, 0)[0]


def fuzzy_detection(
    files: DataFrame, exact: DataFrame | None = None, similarity: float = SIMILARITY, max_bucket: int = MAX_BUCKET, max_pairs: int = MAX_PAIRS, in_scope: DataFrame | None = None, max_bytes: int = 0
) -> tuple[DataFrame, Completeness]:
    """Clones like those of exact_clones, of type-3, always two instances of k tokens each; similarity has two decimals.

    Blocks inside an instance of `exact` are left out, as are pairs less than k tokens apart in one file, pairs within one table, pairs without a
    file of `in_scope`, pairs below `similarity` and equal ones. The most similar pairs are taken first and each block once. Fewer than
    LEAST_TOKENS tokens a window or a similarity of 1 and more give none; with `max_bytes` an index that would be larger is not built.
    """
    done = Completeness()
    b = blocks_of(files.where(F.col("k") >= LEAST_TOKENS))
    if exact is not None:
        i = exact.select(F.explode("instances").alias("i")).select(F.col("i.file_id").alias("f"), F.col("i.start_line").alias("lo"), F.col("i.end_line").alias("hi"))
        b = b.join(i, (b.file_id == i.f) & (b.start_line >= i.lo) & (b.end_line <= i.hi), "left_anti")
    # Ids in the order of (file, place).
    b = cut_lineage(b.withColumn("id", F.shiftleft(F.col("file_id").cast("bigint"), 32) + F.col("pos")))
    if similarity >= 1 or max_bytes and (b.agg(F.sum(F.size("minis"))).first()[0] or 0) * ENTRY_BYTES > max_bytes:
        done.memory_limited = similarity < 1
        b = b.limit(0)
    postings = b.select(F.xxhash64("run_id", "k").alias("of"), "id", F.explode("minis").alias("mini")).select("id", F.xxhash64("of", "mini").alias("h"))
    many = cut_lineage(postings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = many.agg(F.sum("n")).first()[0] or 0
    hot = many.where(F.col("n") > max(1, total // HOT_PARTS)).select("h")  # fewer than HOT_PARTS
    e = salted_lookup(postings, many, "h", hot, F.col("id"), "inner")
    if max_bucket:
        e = cut_lineage(e)
        done.bucket_truncated = e.where(F.col("n") > max_bucket).limit(1).count() > 0
        if done.bucket_truncated:
            e = e.where(F.col("n") <= max_bucket).unionByName(top_within(e.where(F.col("n") > max_bucket), "h", "id", max_bucket))
    pairs = e.select("h", F.col("id").alias("a")).join(e.select("h", F.col("id").alias("b")), "h").where("a < b").select("a", "b").distinct()
    if in_scope is not None:
        seen = F.broadcast(in_scope.select(F.col("file_id").cast("bigint").alias("f")).distinct())
        touched = lambda x: pairs.join(seen, F.shiftright(x, 32) == F.col("f"), "left_semi")
        pairs = touched("a").union(touched("b")).distinct()
    pairs = cut_lineage(pairs)
    done.evaluated = pairs.count()
    if max_pairs and done.evaluated > max_pairs:
        sums = cut_lineage(prefix_sums(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a", "n"))
        done.capped_pairs = sums.where(F.col("before") > max_pairs).limit(1).count() > 0
        pairs = pairs.join(sums.where(F.col("before") <= max_pairs).select("a"), "a", "left_semi")
    info = lambda x: b.select(F.col("id").alias(x), F.col("k").alias("_k" + x), F.col("in_table").alias("t" + x), F.col("run_id").alias("r" + x))
    apart = (F.shiftright("a", 32) != F.shiftright("b", 32)) | (F.col("b") - F.col("a") >= F.col("_ka")) & ~((F.col("ta") >= 0) & (F.col("ta") == F.col("tb")))
    met = pairs.join(info("a"), "a").join(info("b"), "b").where(F.col("ra").eqNullSafe(F.col("rb")) & (F.col("_ka") == F.col("_kb")) & apart).select("a", "b")
    s = lambda x: b.select(F.col("id").alias(x), F.col("minis").alias("m" + x))
    inter = F.size(F.array_intersect("ma", "mb"))
    sim = inter.cast("double") / (F.size("ma") + F.size("mb") - inter)
    pairs = met.join(s("a"), "a").join(s("b"), "b").select("a", "b", sim.alias("score")).where((F.col("score") >= similarity) & (F.col("score") < 1.0))
    taken = greedy_matching(pairs)
    side = lambda x: b.select(F.col("id").alias(x), F.col("full").alias("full" + x), "run_id" if x == "a" else F.lit(0).alias("_"), F.col("k").alias("k" + x), F.struct("file_id", "path", "start_line", "end_line", "function").alias("i" + x))

    @F.pandas_udf("string")
    def pair_hash(x: pd.Series, y: pd.Series) -> pd.Series:
        from ..functions.lexer import fnv64

        return pd.Series([f"{fnv64(':'.join(sorted(p)).encode()):016x}" for p in zip(x, y)], dtype=object)

    j = taken.join(side("a"), "a").join(side("b"), "b")
    found = j.select(
        "run_id", F.concat_ws(":", F.shiftright("a", 32), F.col("a").bitwiseAND((1 << 32) - 1)).alias("clone"), pair_hash("fulla", "fullb").alias("hash"), F.lit("type-3").alias("clone_type"),
        F.col("ka").alias("token_count"), (F.col("ia.end_line") - F.col("ia.start_line") + 1).alias("line_count"), F.array("ia", "ib").alias("instances"), F.round("score", 2).alias("similarity"),
    )
    return found, done
