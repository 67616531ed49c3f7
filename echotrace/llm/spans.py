"""Long exact token spans shared between files of a run, by fixed-block anchors.

Any span of k tokens contains a whole block of B = (k+1)//2 tokens that starts at a multiple of B in its file. So:
1. index the non-overlapping blocks of every file by content hash (1/B of all positions);
2. probe the index with every rolling window of B tokens; an anchor is alive when its content also stands in another file;
3. extend: the k-token windows around alive anchors are hashed in turn, and those whose content stands in two files of
   the run are shared; the maximal stretches of tokens under shared windows are the result.
Step 3 compares contents, not pairs of places, so a block that a third of all files share costs one row per place.

Hashes are rolling polynomials over 64-bit token codes, computed with prefix sums over whole Arrow batches. Windows are equal when two
such hashes with independent bases agree, 128 bits together. The run is mixed into every hash, so runs never meet.

Before the shuffles of steps 2 and 3 a bitmap drops windows that no anchor can match: BITS_PER_ANCHOR bits for each anchor, so the
share that passes is the same at every size, up to MOST_BITS (128 MB, the most that is ever broadcast). Beyond that more windows pass to the exact
join or grouping, 16 bytes each; none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators.skew import HOT_PARTS, salted_lookup
from ..session import cut_lineage, table

#: What a null or 0 in detect_runs.min_tokens stands for (fixed value).
DEFAULT_MIN_TOKENS = 50
#: Bits of a prefilter's bitmap for each anchor, and the most and fewest that it has.
BITS_PER_ANCHOR, MOST_BITS, FEWEST_BITS = 8, 1 << 30, 1 << 20
#: Where in a hash its bits of the bitmap begin; three of them let about 3 % of other hashes pass.
SHIFTS = (0, 17, 34)
#: Tokens hashed at once in a Python worker.
CHUNK_TOKENS = 400_000

_U = np.uint64
_BASES = ((_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)), (_U(0xC2B2AE3D27D4EB4F), _U(0xA0761D6478BD642F)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=_U)
        if n:
            p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Hasher:
    """Rolling window hashes of many files at once, grown tables of powers kept."""

    def __init__(self, which: int):
        self.base, self.salt, self.pow, self.inv = int(_BASES[which][0]), _BASES[which][1], None, None

    def __call__(self, codes: np.ndarray, width: np.ndarray, run: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hash of the width[i] tokens from start[i], for a run; all given per window."""
        n = len(codes) + 1
        if self.pow is None or len(self.pow) < n:
            self.pow, self.inv = _powers(n, self.base)
        sums = np.zeros(n, dtype=_U)
        np.cumsum((codes ^ self.salt) * self.pow[: n - 1], out=sums[1:])
        h = (sums[start + width] - sums[start]) * self.inv[start]
        return _mix(h ^ _mix(run.astype(np.int64).view(_U) * _U(2) + _U(1)) ^ width.astype(_U))


def _chunks(batches):
    """(file_id, run_id, k, lengths, codes) of whole files, about CHUNK_TOKENS tokens together."""
    for b in batches:
        col = b.column(3)
        off = np.asarray(col.offsets)
        codes = np.asarray(col.values.fill_null(0)).view(_U)
        ids = [np.asarray(b.column(i)) for i in range(3)]
        i, n = 0, b.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_TOKENS, side="right")) - 1))
            yield (*(x[i:j] for x in ids), np.diff(off[i : j + 1]), codes[off[i] : off[j]])
            i = j


def _windows(width: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(file index, place in the chunk, place in the file) of every window of its file's width."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    base = np.cumsum(lengths) - lengths
    pos = np.arange(len(owner)) - base[owner]
    ok = pos + width[owner] <= lengths[owner]
    return owner[ok], np.flatnonzero(ok), pos[ok]


def _block(k: np.ndarray) -> np.ndarray:
    return (k + 1) // 2


def _test(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap lets pass: all bits of theirs are set."""
    out = np.arange(len(h))
    for shift in SHIFTS:
        b = ((h[out] >> _U(shift)) & _U(8 * len(bitmap) - 1)).astype(np.int64)
        out = out[(bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1]
    keep = np.zeros(len(h), dtype=bool)
    keep[out] = True
    return keep


def _rows(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f"c{i}" for i in range(len(cols))])


def _named(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def anchors(files: DataFrame) -> DataFrame:
    """(h, file_id): the content hash of each block at a multiple of its run's block length, with its file."""

    def run(batches):
        hasher = _Hasher(0)
        for fid, rid, k, lengths, codes in _chunks(batches):
            width = _block(k)
            own, at, pos = _windows(width, lengths)
            keep = pos % width[own] == 0
            own, at = own[keep], at[keep]
            yield _rows(hasher(codes, width[own], rid[own], at).view(np.int64), fid[own].astype(np.int64))

    return _named(files.mapInArrow(run, "c0 bigint, c1 bigint"), "h", "file_id")


def probes(files: DataFrame, bitmap) -> DataFrame:
    """(h, file_id) of the rolling windows that pass the bitmap; per batch only two files of each content are named."""

    def run(batches):
        hasher, bits = _Hasher(0), np.frombuffer(bitmap.value, dtype=np.uint8)
        for fid, rid, k, lengths, codes in _chunks(batches):
            width = _block(k)
            own, at, _ = _windows(width, lengths)
            h = hasher(codes, width[own], rid[own], at)
            keep = _test(bits, h)
            h, f = h[keep].view(np.int64), fid[own[keep]].astype(np.int64)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, f = h[order], f[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            lo, hi = np.minimum.reduceat(f, first), np.maximum.reduceat(f, first)
            h, two = h[first], lo != hi
            yield _rows(np.r_[h, h[two]], np.r_[lo, hi[two]])

    return _named(files.mapInArrow(run, "c0 bigint, c1 bigint"), "h", "file_id")


def candidates(files: DataFrame, bitmap) -> DataFrame:
    """(h, g, file_id, pos) of each k-token window that contains a block which the bitmap lets pass; h and g are independent hashes."""

    def run(batches):
        blocks, wide, bits = _Hasher(0), _Hasher(1), np.frombuffer(bitmap.value, dtype=np.uint8)
        for fid, rid, k, lengths, codes in _chunks(batches):
            width = _block(k)
            own, at, pos = _windows(width, lengths)
            keep = pos % width[own] == 0
            own, at = own[keep], at[keep]
            if not len(at):
                continue
            live = np.zeros(len(codes) + 1, dtype=np.int64)
            live[at[_test(bits, blocks(codes, width[own], rid[own], at))] + 1] = 1
            live = np.cumsum(live)  # alive blocks that begin before each place
            own, at, pos = _windows(k, lengths)
            last = at + k[own] - width[own]  # the last place where a whole block still fits
            keep = live[last + 1] > live[at] if len(at) else np.zeros(0, dtype=bool)
            own, at, pos = own[keep], at[keep], pos[keep]
            if len(at):
                h, g = (x(codes, k[own], rid[own], at).view(np.int64) for x in (wide, blocks))
                yield _rows(h, g, fid[own].astype(np.int64), pos.astype(np.int32))

    return _named(files.mapInArrow(run, "c0 bigint, c1 bigint, c2 bigint, c3 int"), "h", "g", "file_id", "pos")


def bitmap_of(df: DataFrame, anchors: int):
    """A broadcast bitmap of the hashes in `df`, for so many anchors; it is built in pieces of 4 kB by the executors."""
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << (max(BITS_PER_ANCHOR * anchors, 2) - 1).bit_length()))
    bits = F.array(*(F.shiftrightunsigned("h", n).bitwiseAND(F.lit(size - 1)) for n in SHIFTS))
    pieces = (
        df.select(F.explode(bits).alias("bit"))
        .select((F.col("bit") / 32768).cast("int").alias("piece"), (F.col("bit") % 32768).cast("bigint").alias("at"))
        .repartition("piece")  # a task's partial bitmaps would be as large as the whole
        .groupBy("piece")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
    )
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in pieces.toLocalIterator():
        out[r.piece * 4096 : (r.piece + 1) * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def coded_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id, run_id, k, codes): 64-bit codes of each file's tokens and its run's span length.

    Files without tokens, a run or an id take part in nothing; repeated rows of a file do no harm, as two places count
    only in two files. A null token equals a null token.
    """
    k = runs.where("run_id is not null").groupBy("run_id").agg(
        F.coalesce(F.nullif(F.max("min_tokens"), F.lit(0)), F.lit(DEFAULT_MIN_TOKENS)).alias("k")
    )
    return (
        files.where("file_id is not null and run_id is not null and size(tokens) > 0")
        .select("file_id", "run_id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("codes"))
        .join(k, "run_id", "left")
        .select(F.col("file_id").cast("bigint"), F.col("run_id").cast("bigint"), F.coalesce("k", F.lit(DEFAULT_MIN_TOKENS)).cast("bigint").alias("k"), "codes")
    )


def shared_windows(coded: DataFrame) -> DataFrame:
    """(file_id, pos) of every k-token window whose content stands in another file of its run; may repeat."""
    index = anchors(coded)
    held = cut_lineage(index.groupBy("h").agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi")))
    first = bitmap_of(held, held.count())
    met = cut_lineage(probes(coded, first).join(held.hint("shuffle_hash"), "h").where("file_id <> lo or lo <> hi").select("h").distinct())
    alive = bitmap_of(met, met.count())
    cand = cut_lineage(candidates(coded, alive))
    key = ["h", "g"]
    both = cut_lineage(cand.groupBy(*key).agg(F.min("file_id").alias("lo"), F.max("file_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select(*key, "n"))
    total = both.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT_PARTS contents can stand in more than total/HOT_PARTS places.
    hot = both.where(F.col("n") > max(1, total // HOT_PARTS)).select(*key)
    return salted_lookup(cand, both.select(*key), key, hot, F.xxhash64("file_id", "pos"), "inner").select("file_id", "pos")


def shared_spans(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id, start_tok, end_tok): maximal stretches of token positions that lie in some shared span, ends inclusive."""
    k = coded_files(files, runs)
    widths = k.select("file_id", "k").distinct()
    w = shared_windows(k).distinct().join(widths, "file_id")
    by_pos = Window.partitionBy("file_id").orderBy("pos")
    # All windows of a file are equally wide, so the window before in order is the one that reaches furthest.
    gap = F.col("pos") > F.lag("pos").over(by_pos) + F.col("k")
    marked = w.withColumn("island", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(by_pos))
    return marked.groupBy("file_id", "island").agg(
        F.min("pos").alias("start_tok"), (F.max("pos") + F.max("k") - 1).cast("int").alias("end_tok")
    ).select(F.col("file_id").cast("int").alias("file_id"), "start_tok", "end_tok")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal shared stretch of every file."""
    return shared_spans(table(spark, sf_dir, "tokenized_files"), table(spark, sf_dir, "detect_runs"))


def p3_file_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file with tokens: its tokens, those shared with other files of its run, and the share in per cent to one decimal."""
    files = table(spark, sf_dir, "tokenized_files")
    spans = shared_spans(files, table(spark, sf_dir, "detect_runs"))
    shared = spans.groupBy("file_id").agg(F.sum(F.col("end_tok") - F.col("start_tok") + 1).alias("shared"), F.count(F.lit(1)).alias("n_spans"))
    all_files = files.where("file_id is not null and run_id is not null and tokens is not null").groupBy("file_id").agg(F.max(F.size("tokens")).alias("n_tokens"))
    s = F.coalesce("shared", F.lit(0))
    return all_files.join(shared, "file_id", "left").select(
        "file_id", "n_tokens", s.cast("bigint").alias("shared_tokens"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.round(s * 1000 / F.greatest("n_tokens", F.lit(1)), 0).__truediv__(10).alias("duplication_pct"),
    )


_SPANS = f"""
  WITH r AS (SELECT run_id, coalesce(nullif(max(min_tokens), 0), {DEFAULT_MIN_TOKENS}) AS k FROM detect_runs GROUP BY 1),
  f AS (SELECT file_id, run_id, any_value(tokens) AS t, any_value(coalesce(k, {DEFAULT_MIN_TOKENS})) AS k
    FROM tokenized_files LEFT JOIN r USING (run_id) WHERE tokens IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT *, unnest(range(0, len(t) - k + 1)) AS pos FROM f WHERE len(t) >= k),
  w AS (SELECT run_id, file_id, k, pos, md5(array_to_string(t[pos + 1 : pos + k], chr(1))) AS h FROM p),
  s AS (SELECT file_id, k, pos FROM w WHERE (run_id, h) IN (SELECT (run_id, h) FROM w GROUP BY run_id, h HAVING min(file_id) <> max(file_id))),
  g AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY file_id ORDER BY pos) + k THEN 1 ELSE 0 END AS gap FROM s),
  i AS (SELECT *, sum(gap) OVER (PARTITION BY file_id ORDER BY pos) AS island FROM g),
  spans AS (SELECT file_id, CAST(min(pos) AS INTEGER) AS start_tok, CAST(max(pos) + max(k) - 1 AS INTEGER) AS end_tok FROM i GROUP BY file_id, island)
"""
QUERIES = {"p3_found": p3_found, "p3_file_shares": p3_file_shares}
ORACLES = {
    "p3_found": _SPANS + "SELECT * FROM spans",
    "p3_file_shares": _SPANS
    + """, a AS (SELECT file_id, max(len(tokens)) AS n_tokens FROM tokenized_files WHERE tokens IS NOT NULL GROUP BY 1),
      c AS (SELECT file_id, sum(end_tok - start_tok + 1) AS shared, count(*) AS n FROM spans GROUP BY 1)
      SELECT file_id, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(coalesce(shared, 0) AS BIGINT) AS shared_tokens, coalesce(n, 0) AS n_spans,
      round(coalesce(shared, 0) * 1000 / greatest(n_tokens, 1), 0) / 10 AS duplication_pct FROM a LEFT JOIN c USING (file_id)""",
}
