"""Template residue and error-page text in documents, by character n-gram models and likelihood-ratio windows.

Models of characters for slots of templates, filler and notices (of servers and browsers) are fitted on public wording
(residue_seeds), the model of natural prose on all documents. A model gives the share of each n-gram in its text; shares, not
counts, so that a document is judged alike however much else is read. A table of log-likelihood ratios against prose
follows for each kind, and a text is read against it in pieces:

* filler and notices: a piece (a sentence, a line or a quotation) is residue when windows of strong ratio cover it and the evidence of the
  whole piece, the sum of its ratios, is large enough; or when one stretch of strong windows holds as much by itself.
* slots: the pieces are bracketed groups, repeated words and single words, read as they are and as shapes.

In a second round, pieces that are residue beyond doubt join their model and leave prose, which they had been counted in.

What a speaker quotes is spoken of and not residue, if prose around the quotation on its line says so; a quotation that stands alone is judged
as any other piece. Nothing is cut: every character of every text is read, and each distinct piece of a batch is judged once.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage, table
from .residue_seeds import SEEDS

#: Lengths of n-grams, with how much each counts in a ratio.
ORDERS = ((3, 0.4), (5, 0.6))
#: A table's cells for each order.
BITS = 20
TABLE = 1 << BITS
#: What pieces are compared with, and the shares of n-grams that are as good as none. Invented Latin repeats few words, so it has to pass
#: for unknown where it makes up a good part of a collection.
UNKNOWN = {"filler": {3: 3e-5, 5: 4e-6}, "notice": {3: 3e-5, 5: 4e-6}, "foreign": {3: 2e-4, 5: 3e-5}}
#: The share of page furniture in prose.
FURNITURE = 0.01
#: A ratio of one n-gram counts no more than this.
CLIP = 4.0
#: Windows of WINDOW characters are strong above LEVEL; they must cover COVERAGE of a piece whose ratios sum up to EVIDENCE and MEAN a character.
WINDOW, LEVEL, COVERAGE, EVIDENCE, MEAN = 16, 0.6, 0.65, 20.0, 0.5
#: A stretch of strong windows inside a longer piece needs more, less where the piece as a whole is half covered; so do words in no language.
STRETCH, HALF, FOREIGN = 90.0, (0.5, 40.0), 45.0
#: Evidence, and evidence a character, from which the second round learns a piece.
SURE, SURE_MEAN = 30.0, 1.0
#: Words and shapes of units are judged by chains of conditional n-grams up to CHAIN, in tables of 2^CHAIN_BITS cells; LEAN is the share of a
#: context that the shorter one is worth. A slot is so many nats likelier in templates than in prose: one unit in e^SLOT is expected to be one.
CHAIN, CHAIN_BITS, LEAN, SLOT, SURE_SLOT, PLAIN_WORDS = 5, 18, 1e-6, 4.2, 8.0, 3.0

KINDS = ("slot", "filler", "notice")
#: Characters judged at once; a single piece longer than LONGEST is read as several.
CHUNK, LONGEST = 16_000_000, 100_000
#: Lanes of the first of two levels that add up counts.
LANES = 512
_BLOCK = 1 << 14
_DIGITS = re.compile(r"\d+")
_QUOTE = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|‘[^’]*’(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[\"“«(\[¿¡A-ZÀ-Ý0-9{<@_%$#&])")
_UNIT = re.compile(
    r"[^\w\s()\[\]{}<>«»]*(?:\[+[^\[\]]*\]+|\{+[^{}]*\}+|<+[^<>]*>+|\([^()\[\]{}<>@#$%_]*\)|«[^«»]*»)|(?<!\w)([%@$#_?*|~&]{1,2})\w[\w .-]{0,60}\1(?!\w)|(?<!\w)(\w+)(?:,? \2(?!\w))+|[^\s()\[\]<>«»]+|\S"
)
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\n(?=[a-zß-öø-ÿ])")
_NO_MARKS = str.maketrans("", "", ".,;:!?…")
_SIGN = re.compile(r"[()\[\]{}<>«»%@$#_*|~&]|\?\w")
_BARE = re.compile(r"[^\W\d_]+(?:,? [^\W\d_]+)*[.,;:!?]*")
_PLAIN = re.compile(r"[(\[][^\W\d_][^\[\](){}<>_]*[)\]][.,;:!?]*")
_WORD = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"([A-ZÀ-ÖØ-Þ]+)([a-zß-öø-ÿ]*)|[^\W\d_]+|(\d+)")

# Words of speech about a text, in the corpus' languages; near one of them a quoted slot is spoken of.
MENTION = re.compile(
    r"\b(words?|letters?|forms?|templates?|screen|placeholders?|draft|brackets?|blank|Wort\w*|Brief\w*|Formular\w*|Vorlage\w*|Entwurf\w*|Klammer\w*|Platzhalter\w*"
    r"|mots?|lettre|formulaire|modèle|brouillon|crochets|palabras?|carta|formulario|plantilla|borrador|corchetes)\b",
    re.I,
)


def pieces(text: str | None) -> list[tuple[str, int, bool]]:
    """(piece, line, quoted) of a text: quotations, and the sentences of each line around them, numbers being alike. Null and blank texts have none."""
    text = _DIGITS.sub("9", (text or "").replace("\r\n", "\n").replace("\r", "\n"))
    if "-\n" in text:
        text = _HYPHEN.sub("", text)
    out = []
    for n, line in enumerate(text.split("\n")):
        line = " ".join(line.split())
        if not line:
            continue
        if _QUOTE.search(line):
            out += [(p, n, True) for q in _QUOTE.findall(line) for p in _sentences(q[1:-1].strip())]
            line = _QUOTE.sub('"q"', line)
        out += [(p, n, False) for p in _sentences(line)]
    return out


def _sentences(line: str) -> list[str]:
    return [p[i : i + LONGEST] for p in _SENTENCE.split(line) for i in range(0, len(p), LONGEST)]


def units(piece: str) -> list[str]:
    """Bracketed groups with the signs before them, words repeated, and single words of a piece; nothing but blanks is left out."""
    if not _SIGN.search(piece):  # without signs units are words, unless one is repeated
        words, bare = piece.split(), piece.translate(_NO_MARKS).split()
        if len(set(bare)) == len(bare) or not any(a == b for a, b in zip(bare, bare[1:])):
            return words
    return [m[0] for m in _UNIT.finditer(piece)]


def shape(unit: str) -> str:
    """A unit with each run of letters as a, A or Aa, and of digits as 9."""
    return _RUNS.sub(lambda m: ("Aa" if m[2] else "A") if m[1] else "9" if m[3] else "a", unit)


_PAD = b"\n\n\n\n"


class _Grams:
    """Cells of the n-grams that end at each byte of the given texts, which don't reach into their neighbours."""

    def __init__(self, parts: list[str], lower: bool = True):
        raw = [(p.lower() if lower else p).encode("utf-8", "replace") for p in parts]
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.last = np.cumsum(self.size + len(_PAD))  # one beyond the last byte
        self.first = self.last - self.size
        a = np.frombuffer(b"".join(_PAD + r for r in raw), dtype=np.uint8).astype(np.uint64)
        code = a.copy()
        self.cells = {}
        for n in range(1, 5):
            code[n:] |= a[:-n] << np.uint64(8 * n)
            if n in (2, 4):
                self.cells[n + 1] = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        self.inside = np.ones(len(a), dtype=bool)
        for i in range(1, len(_PAD) + 1):
            self.inside[self.first - i] = False


def counts_of(parts: list[str], weight: np.ndarray | None = None, lower: bool = True) -> np.ndarray:
    """(orders, TABLE) counts of the n-grams of texts, each of which counts `weight` times."""
    out = np.zeros((len(ORDERS), TABLE))
    if parts:
        g = _Grams(parts, lower)
        w = np.repeat(np.ones(len(parts)) if weight is None else weight, g.size)
        for i, (n, _) in enumerate(ORDERS):
            out[i] = np.bincount(g.cells[n][g.inside], weights=w, minlength=TABLE)
    return out.astype(np.int64)


def ratios(kind: str, counts: dict[str, np.ndarray]) -> np.ndarray:
    """(orders, TABLE) log-likelihood ratios of a kind against prose, from counts; only shares matter. Without any prose all of it is unknown."""
    out = np.zeros((len(ORDERS), TABLE), dtype=np.float16)
    share = lambda x: x / max(x.sum(), 1)
    for i, (n, w) in enumerate(ORDERS):
        p = (1 - FURNITURE) * share(counts["prose"][i]) + FURNITURE * share(counts["furniture"][i])
        k = share(counts[kind][i])
        sure = counts.get(kind + "_sure")
        if sure is not None and sure[i].any():  # public wording and what was found weigh the same, however much was found
            k = (k + share(sure[i])) / 2
        out[i] = w * np.clip(np.log((k + UNKNOWN[kind][n]) / (p + UNKNOWN[kind][n])), -CLIP, CLIP)
    return out


class _Chain:
    """Cells of the n-grams, n = 1..CHAIN, that end at each byte of the given texts and at their ends, and of what precedes each byte."""

    def __init__(self, parts: list[str]):
        raw = [p.encode("utf-8", "replace") for p in parts]
        self.size = np.array([len(r) + 1 for r in raw], dtype=np.int64)  # the end counts
        a = np.frombuffer(b"".join(_PAD + r + b"\n" for r in raw), dtype=np.uint8).astype(np.uint64)
        self.last = np.cumsum(self.size + len(_PAD))
        self.first = self.last - self.size
        at = np.repeat(self.first - np.r_[0, np.cumsum(self.size)[:-1]], self.size) + np.arange(int(self.size.sum()))
        code, self.grams, self.before = a.copy(), [], []
        for n in range(CHAIN):
            if n:
                code[n:] |= a[:-n] << np.uint64(8 * n)
            cells = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHAIN_BITS)).astype(np.int64)
            self.grams.append(cells[at])
            self.before.append(cells[at - 1])

    def sums(self, x: np.ndarray) -> np.ndarray:
        s = np.r_[0.0, np.cumsum(x)]
        end = np.cumsum(self.size)
        return s[end] - s[end - self.size]


def chain_counts(parts: list[str], weight: np.ndarray | None = None) -> np.ndarray:
    """(2 * CHAIN, cells) counts: of n-grams, and of what precedes a byte; each text counts `weight` times."""
    out = np.zeros((2 * CHAIN, 1 << CHAIN_BITS))
    if parts:
        c = _Chain(parts)
        w = np.repeat(np.ones(len(parts)) if weight is None else weight, c.size)
        for n in range(CHAIN):
            out[n] = np.bincount(c.grams[n], weights=w, minlength=out.shape[1])
            out[CHAIN + n] = np.bincount(c.before[n], weights=w, minlength=out.shape[1])
    return out.astype(np.int64)


def shares(counts: np.ndarray) -> np.ndarray:
    return (counts / max(int(counts[0].sum()), 1)).astype(np.float32)


def chain_logs(share: np.ndarray, c: _Chain) -> np.ndarray:
    """log P of each byte given the ones before it; longer contexts lean on shorter ones. Only shares matter."""
    p = (share[0].take(c.grams[0]) + LEAN) / (1 + 256 * LEAN)
    for n in range(1, CHAIN):
        p = (share[n].take(c.grams[n]) + LEAN * p) / (share[CHAIN + n - 1].take(c.before[n - 1]) + LEAN)
    return np.log(p)


def _along(g: _Grams, table: np.ndarray) -> np.ndarray:
    """The ratio at each byte, 0 between texts."""
    r = sum(table[i].take(g.cells[n]) for i, (n, _) in enumerate(ORDERS)).astype(np.float64)
    r[~g.inside] = 0.0
    return r


def _sums(r: np.ndarray, g: _Grams) -> np.ndarray:
    s = np.r_[0.0, np.cumsum(r)]
    return s[g.last] - s[g.first]


def localise(g: _Grams, r: np.ndarray) -> pd.DataFrame:
    """Per text: the sum of its ratios, the share of it that strong windows cover, and the largest sum of one covered stretch."""
    s = np.r_[0.0, np.cumsum(r)]
    n = len(r)
    at = np.arange(n)
    end = np.minimum(at + WINDOW, np.repeat(g.last, g.size + len(_PAD)))
    start_ok = end - at == WINDOW
    start_ok[g.first[g.size > 0]] = True
    start_ok &= g.inside
    strong = start_ok & ((s[end] - s[at]) > LEVEL * (end - at))
    d = np.zeros(n + 1, dtype=np.int64)
    d[:n] += strong
    np.subtract.at(d, end[strong], 1)
    covered = (np.cumsum(d[:n]) > 0) & g.inside
    c = np.r_[0, np.cumsum(covered)]
    edge = np.diff(np.r_[0, covered.astype(np.int8), 0])
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    best = np.zeros(len(g.size))
    if len(lo):
        np.maximum.at(best, np.searchsorted(g.last, lo, side="right"), s[hi] - s[lo])
    return pd.DataFrame({"size": g.size, "sum": s[g.last] - s[g.first], "cover": (c[g.last] - c[g.first]) / np.maximum(g.size, 1), "stretch": best})


def judge_pieces(parts: list[str], models) -> pd.DataFrame:
    """Per piece: whether it is filler, is a notice, and is so beyond doubt."""
    g = _Grams(parts)
    out = {"size": g.size}
    for k in ("filler", "notice", "foreign"):
        j = localise(g, _along(g, models[k]))
        whole = (j["cover"] >= COVERAGE) & (j["sum"] >= (FOREIGN if k == "foreign" else EVIDENCE)) & (j["sum"] >= MEAN * j["size"])
        out[k + "_sum"], out[k + "_cover"], out[k + "_stretch"] = j["sum"], j["cover"], j["stretch"]
        half = (j["cover"] >= HALF[0]) & (j["sum"] >= HALF[1])
        out[k] = whole if k == "foreign" else whole | half | (j["stretch"] >= STRETCH)
        out[k + "_sure"] = whole & (j["sum"] >= SURE) & (j["sum"] >= SURE_MEAN * j["size"])
    out["filler"] |= out["foreign"]
    out["filler_sure"] |= out["foreign"]
    return pd.DataFrame(out)


def words(unit: str) -> list[str]:
    """The words of a unit, without its signs."""
    return _WORD.findall(unit.lower())


def unit_views(parts: list[str]) -> dict[str, tuple[list[str], np.ndarray]]:
    """What the models of slots read of units: their words and their shapes, each with the unit that it belongs to."""
    own = [words(p) for p in parts]
    return {
        "word": ([w for ws in own for w in ws], np.repeat(np.arange(len(parts)), [len(ws) for ws in own])),
        "shape": ([shape(p) for p in parts], np.arange(len(parts))),
    }


def unit_counts(parts: list[str], weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    weight = np.ones(len(parts)) if weight is None else weight
    return {v: chain_counts(texts, weight[own]) for v, (texts, own) in unit_views(parts).items()}


def judge_units(parts: list[str], models) -> pd.DataFrame:
    """Per unit: how much likelier its words and its shape are in slots than in prose, and whether it is a slot, and plainly written.

    Half of the words in slots are any words of prose. Plain brackets, as remarks of the clerk have them, need words of a slot; words
    without any sign need more of that, and no shape makes up for it.
    """
    out = {}
    for v, (texts, own) in unit_views(parts).items():
        c = _Chain(texts)
        r = c.sums(chain_logs(models[v, "slot"], c) - chain_logs(models[v, "prose"], c))
        out[v] = np.bincount(own, weights=np.logaddexp(r, 0.0) - np.log(2.0) if v == "word" else r, minlength=len(parts))
    bare, plain = (np.array([bool(x.fullmatch(p)) for p in parts], dtype=bool) for x in (_BARE, _PLAIN))
    total = out["word"] + np.where(bare, np.minimum(out["shape"], 0.0), out["shape"])
    sure = total >= SURE_SLOT
    slot = np.where(bare, sure, (total >= SLOT) & (~plain | (out["word"] >= PLAIN_WORDS)))
    return pd.DataFrame({**out, "slot": slot, "plain": bare | plain})


class _Chunk:
    """The pieces of some texts, each distinct piece and each distinct unit once, with how often it stands there."""

    def __init__(self, texts: list[str | None]):
        rows = [(i, *p) for i, t in enumerate(texts) for p in pieces(t)]
        self.n = len(texts)
        self.doc, self.line = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 2))
        self.quoted = np.array([r[3] for r in rows], dtype=bool)
        self.code, uniq = pd.factorize(np.array([r[1] for r in rows], dtype=object))
        self.parts, self.times = list(uniq), np.bincount(self.code, minlength=len(uniq))

    def split(self) -> None:
        """Find the units of the pieces."""
        per = [units(p) for p in self.parts]
        self.owner = np.repeat(np.arange(len(per)), [len(u) for u in per])
        self.unit, uniq = pd.factorize(np.array([u for us in per for u in us], dtype=object))
        self.units = list(uniq)
        self.unit_times = np.bincount(self.unit, weights=self.times[self.owner], minlength=len(uniq))

    def any_of(self, flag: np.ndarray) -> np.ndarray:
        """Which pieces hold a unit with the flag."""
        return np.bincount(self.owner, weights=flag[self.unit], minlength=len(self.parts)) > 0

    def judged(self, models) -> pd.DataFrame:
        """Per text: how many pieces of each kind it holds, and the share of it that they take. What a speaker quotes or speaks of is left out."""
        if not self.parts:
            return pd.DataFrame({k: np.zeros(self.n) for k in (*KINDS, "coverage")})
        self.split()
        j, u = judge_pieces(self.parts, models), judge_units(self.units, models)
        slot = self.any_of(u["slot"].to_numpy(float))
        rest = j["filler"].to_numpy() | j["notice"].to_numpy()
        # Only what holds a slot or stands around a quotation can speak of one.
        lines = self.doc * (self.line.max() + 1) + self.line
        asked = slot | (np.bincount(self.code, weights=np.isin(lines, lines[self.quoted]), minlength=len(self.parts)) > 0)
        speaks = np.array([bool(a and MENTION.search(p)) for a, p in zip(asked, self.parts)], dtype=bool)
        spoken_slot = slot & speaks & ~self.any_of((u["slot"] & ~u["plain"]).to_numpy(float)) & ~rest  # a bracket that its sentence speaks of
        bad = (slot & ~spoken_slot) | rest
        prose = ~bad & np.array([len(p.split()) > 2 for p in self.parts], dtype=bool)
        # On each line: is there prose around its quotations, and does it speak of a text?
        place, at = np.unique(lines, return_inverse=True)
        around = lambda f: np.bincount(at, weights=(f[self.code] & ~self.quoted), minlength=len(place))[at] > 0
        host, spoken = around(prose), around(prose & speaks)
        counts = bad[self.code] & ~(self.quoted & np.where(rest[self.code], host, host & spoken))
        out = {k: np.bincount(self.doc, weights=counts & f[self.code], minlength=self.n) for k, f in (("slot", slot), ("filler", j["filler"].to_numpy()), ("notice", j["notice"].to_numpy()))}
        size = j["size"].to_numpy(float)[self.code]
        out["coverage"] = np.bincount(self.doc, weights=counts * size, minlength=self.n) / np.maximum(np.bincount(self.doc, weights=size, minlength=self.n), 1)
        return pd.DataFrame(out)

    def prose(self) -> dict[str, np.ndarray]:
        self.split()
        return {"prose": counts_of(self.parts, self.times), **{v + "_prose": c for v, c in unit_counts(self.units, self.unit_times).items()}}

    def sure(self, models) -> dict[str, np.ndarray]:
        """Counts of the pieces that are residue for certain: what to add to each kind, and to take from prose."""
        if not self.parts:
            return {}
        j, out = judge_pieces(self.parts, models), {}
        for k in ("filler", "notice"):
            f = np.flatnonzero(j[k + "_sure"])
            out[k] = counts_of([self.parts[i] for i in f], self.times[f])
        return out


def _chunks(batches):
    """(rows, chunk) of about CHUNK characters."""
    for pdf in batches:
        sizes = pdf["text"].map(lambda t: len(t or "")).to_numpy()
        part = (np.cumsum(sizes) // CHUNK) if len(sizes) else sizes
        for _, rows in pdf.groupby(part, sort=False):
            yield rows, _Chunk(rows["text"].tolist())


_COUNTS = "name string, block int, lane int, counts binary"
_SHAPES = {"prose": (len(ORDERS), TABLE), "filler": (len(ORDERS), TABLE), "notice": (len(ORDERS), TABLE), "word_prose": (2 * CHAIN, 1 << CHAIN_BITS), "shape_prose": (2 * CHAIN, 1 << CHAIN_BITS)}


def _packed(totals: dict[str, np.ndarray], lane: int) -> pd.DataFrame:
    """The cells above 0 of tables of counts, in blocks."""
    rows = []
    for name, total in totals.items():
        flat = total.reshape(-1, _BLOCK)
        for b in np.flatnonzero(flat.any(axis=1)):
            cells = np.flatnonzero(flat[b])
            rows.append((name, b, lane, zlib.compress(cells.astype("<u2").tobytes() + flat[b][cells].astype("<i8").tobytes(), 1)))
    return pd.DataFrame(rows, columns=["name", "block", "lane", "counts"])


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    n = len(raw) // 10
    return np.frombuffer(raw[: 2 * n], dtype="<u2"), np.frombuffer(raw[2 * n :], dtype="<i8")


def _gather(docs: DataFrame, counts) -> dict[str, np.ndarray]:
    """Sums of the counts of all chunks. They are added within tasks, then in LANES lanes, then over the lanes; their size is fixed."""

    def run(batches):
        from pyspark import TaskContext

        total: dict[str, np.ndarray] = {}
        for _, chunk in _chunks(batches):
            for k, c in counts(chunk).items():
                total[k] = total[k] + c if k in total else c
        yield _packed(total, TaskContext.get().partitionId() % LANES)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1, _BLOCK), dtype=np.int64)
        for c in pdf["counts"]:
            cells, n = _unpacked(c)
            total[0, cells] += n
        out = _packed({pdf["name"].iloc[0]: total}, pdf["lane"].iloc[0])
        return out.assign(block=pdf["block"].iloc[0])

    lanes = docs.select("text").mapInPandas(run, _COUNTS)
    if lanes._jdf.queryExecution().toRdd().getNumPartitions() > LANES:  # else each lane holds one task's blocks already
        lanes = lanes.groupBy("name", "block", "lane").applyInPandas(add, _COUNTS)
    sums = cut_lineage(lanes.groupBy("name", "block").applyInPandas(add, _COUNTS))
    out = {k: np.zeros(s, dtype=np.int64) for k, s in _SHAPES.items()}
    for r in sums.toLocalIterator():
        cells, n = _unpacked(r.counts)
        out[r.name].reshape(-1, _BLOCK)[r.block, cells] = n
    return out


def seed_counts() -> dict[str, np.ndarray]:
    out = {k: counts_of([p for s in SEEDS[k] for p, _, _ in pieces(s)]) for k in ("filler", "notice", "foreign", "furniture")}
    return out | {v + "_slot": c for v, c in unit_counts([u for s in SEEDS["slot"] for u in units(s)]).items()}


def models_of(counts: dict[str, np.ndarray]) -> dict:
    """What texts are judged by: ratio tables of the kinds of pieces, shares of the units' chains."""
    out: dict = {k: ratios(k, counts) for k in UNKNOWN}
    return out | {(v, k): shares(counts[f"{v}_{k}"]) for v in ("word", "shape") for k in ("slot", "prose")}


def learned(start: dict[str, np.ndarray], sure: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The first round's counts with what is certain moved from prose to its kind."""
    out = dict(start)
    for k in ("filler", "notice"):
        out[k + "_sure"] = sure[k]
        out["prose"] = np.maximum(out["prose"] - sure[k], 0)
    return out


def _send(spark: SparkSession, models: dict):
    """Broadcast models compressed, as most cells are alike; their size is fixed."""
    return spark.sparkContext.broadcast({k: (m.dtype.str, m.shape, zlib.compress(m.tobytes(), 1)) for k, m in models.items()})


_OPENED: dict = {}


def _open(sent) -> dict:
    """A worker's models, unpacked once."""
    if sent.value is not _OPENED.get("of"):
        _OPENED.clear()
        _OPENED.update({"of": sent.value, "models": {k: np.frombuffer(zlib.decompress(m), dtype=t).reshape(s).astype(np.float32) for k, (t, s, m) in sent.value.items()}})
    return _OPENED["models"]


def fit(docs: DataFrame) -> dict:
    """All models, after the second round."""
    counts = seed_counts() | {k: c for k, c in _gather(docs, lambda chunk: chunk.prose()).items() if "prose" in k}
    first = _send(docs.sparkSession, models_of(counts))
    return models_of(learned(counts, _gather(docs, lambda chunk: chunk.sure(_open(first)))))


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, slot, filler, notice, coverage): each document with residue, the pieces of each kind, and their share of its text.

    Empty and null texts have no residue; a repeated doc_id is judged by any of its rows, a null one is left out. Other columns are not read.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    models = _send(docs.sparkSession, fit(docs))

    def run(batches):
        for rows, chunk in _chunks(batches):
            j = chunk.judged(_open(models))
            out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), **{k: j[k].to_numpy().astype(int) for k in KINDS}, "coverage": j["coverage"].to_numpy()})
            yield out[out[list(KINDS)].any(axis=1)]

    found = docs.mapInPandas(run, "doc_id bigint, slot int, filler int, notice int, coverage double")
    return found.groupBy("doc_id").agg(*(F.max(k).alias(k) for k in (*KINDS, "coverage")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with residue anywhere in its text."""
    return residue(table(spark, sf_dir, "documents")).select("doc_id")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with residue: pieces of each kind, and the share of the text they take."""
    return residue(table(spark, sf_dir, "documents")).withColumn("coverage", F.round("coverage", 4))


QUERIES = {"p8_found": p8_found, "p8_coverage": p8_coverage}
ORACLES: dict[str, str] = {}
