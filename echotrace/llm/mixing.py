"""Mixing sources to target shares of the total size, by iterative proportional fitting and calibrated sampling.

Tokens are summed per cell of (source, language, topic). Raking scales the cells until their sums agree with the source
targets, the language targets and the topic targets, sources last and exactly. The total is the largest at which no source
(no cell, where a caller gives targets of languages or topics) needs more than its max_repeats; a cell that would exceed it gives its surplus to the other cells of its source. A cell's
rate then says how often a text of it occurs: the whole part for all, and one more for the texts whose hash falls below a
threshold that is calibrated on the source's own texts, so that the tokens chosen, not just their expectation, meet the rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, table
from .tokens import with_size

#: Topics and languages told apart unless a caller says otherwise; the rest form one more of each ('other'), so the cells have a fixed bound.
TOPICS, LANGUAGES = 500, 20
#: Default targets of topics within a language: their natural shares to this power, which lifts rare topics.
TEMPER = 0.7
ROUNDS = 200
#: Steps of the calibration within a source, and how far above its expectation a text's chance is looked at.
STEPS, SPAN = 256, 4.0


def clean_source(c: Column) -> Column:
    """Sources are spelled unevenly: case, blanks and hyphens don't matter."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def clean_lang(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("und"))


def clean_topic(c: Column) -> Column:
    """The title of an agenda item without its number."""
    return F.coalesce(F.nullif(F.lower(F.trim(F.regexp_replace(c, r"^\s*\d+\s*[.)]?\s*", ""))), F.lit("")), F.lit("none"))


def _fold(df: DataFrame, col: str, keep: int) -> DataFrame:
    """Replace all but the `keep` values with the most tokens by 'other'."""
    top = df.groupBy(col).agg(F.sum("n_tokens").alias("_t")).orderBy(F.desc("_t"), col).limit(keep).select(col, F.lit(True).alias("_keep"))
    return df.join(F.broadcast(top), col, "left").withColumn(col, F.when(F.col("_keep"), F.col(col)).otherwise(F.lit("other"))).drop("_keep")


def rake(cells: pd.DataFrame, shares: dict[str, float], languages: dict | None = None, topics: dict | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of the cells (source, lang, topic, tokens) that agree with the targets; sources are met exactly.

    Languages and topics without targets get those that follow from the sources' own languages, and their tempered topics.
    """
    x = cells["tokens"].to_numpy(float).copy()
    code = {k: pd.factorize(cells[k]) for k in ("source", "lang", "topic")}
    sums = lambda k, v: np.bincount(code[k][0], weights=v, minlength=len(code[k][1]))
    want = {"source": np.array([shares[s] for s in code["source"][1]])}
    want["source"] = want["source"] / want["source"].sum()
    natural = x * (want["source"] / sums("source", x))[code["source"][0]]
    want["lang"] = sums("lang", natural) if languages is None else np.array([languages.get(v, 0.0) for v in code["lang"][1]])
    if topics is None:
        both = pd.DataFrame({"l": code["lang"][0], "t": code["topic"][0], "v": natural}).groupby(["l", "t"])["v"].sum()
        soft = both**TEMPER
        soft = soft / soft.groupby("l").transform("sum") * both.groupby("l").transform("sum")
        want["topic"] = soft.groupby("t").sum().reindex(range(len(code["topic"][1])), fill_value=0.0).to_numpy()
    else:
        want["topic"] = np.array([topics.get(v, 0.0) for v in code["topic"][1]])
    for _ in range(rounds):
        before = x / max(x.sum(), 1e-300)
        for k in ("topic", "lang", "source"):
            have = sums(k, x)
            x = x * np.divide(want[k], have, out=np.zeros_like(have), where=have > 0)[code[k][0]]
        if np.abs(x - before).max(initial=0.0) < 1e-12:
            break
    return x


def rates(cells: pd.DataFrame, targets: pd.DataFrame, total: float | None = None, languages: dict | None = None, topics: dict | None = None) -> pd.DataFrame:
    """The cells with `rate`, how often their tokens are to occur, none above its source's max_repeats."""
    cells = cells[cells["tokens"] > 0].merge(targets, on="source").query("target_share > 0 and max_repeats > 0").reset_index(drop=True)
    if not len(cells):
        return cells.assign(rate=np.zeros(0))
    share = rake(cells, dict(zip(targets["source"], targets["target_share"])), languages, topics)
    have = cells.groupby("source")["tokens"].sum()
    want = pd.Series(share).groupby(cells["source"]).sum()
    cap = cells.groupby("source")["max_repeats"].first()
    most = float((have * cap / want.reindex(have.index)).min())
    if languages is not None or topics is not None:  # targets that a caller gives hold within every source, so no cell may need more
        used = share > 0
        most = float((cells["tokens"].to_numpy(float) * cells["source"].map(cap).to_numpy(float))[used].__truediv__(share[used]).min())
    size = min(total or most, most)
    out = np.zeros(len(cells))
    for s, g in cells.groupby("source"):
        at, t, c = g.index.to_numpy(), g["tokens"].to_numpy(float), float(cap[s])
        need, free, rate = size * want[s], np.ones(len(g), dtype=bool), np.zeros(len(g))
        for _ in range(len(g) + 1):
            w = share[at] * free
            left = need - (rate * t)[~free].sum()
            r = left * np.divide(w, w.sum()) / t if w.sum() > 0 else np.zeros(len(g))
            over = free & (r > c)
            rate[free] = np.minimum(r[free], c)
            if not over.any():
                break
            free &= ~over
        out[at] = rate
    return cells.assign(rate=out)


def sized_documents(docs: DataFrame, topics: int = TOPICS, languages: int = LANGUAGES) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) with cleaned labels, the topics and languages with the fewest tokens folded; documents without an id are left out."""
    return fold(sized_labels(docs), topics, languages)


def fold(labelled: DataFrame, topics: int = TOPICS, languages: int = LANGUAGES) -> DataFrame:
    return _fold(_fold(labelled, "topic", topics), "lang", languages)


def sized_labels(docs: DataFrame) -> DataFrame:
    d = with_size(docs.where("doc_id is not null").select("doc_id", "text", "source", "lang", "agenda_item"))
    return cut_lineage(d.select("doc_id", clean_source(F.col("source")).alias("source"), clean_lang(F.col("lang")).alias("lang"), clean_topic(F.col("agenda_item")).alias("topic"), "n_tokens"))


def clean_targets(targets: DataFrame) -> DataFrame:
    return targets.where("source is not null").groupBy(clean_source(F.col("source")).alias("source")).agg(
        F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats")
    )


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, languages: dict | None = None, topics: dict | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, copies): every chosen text and how often it occurs.

    `languages` and `topics` are target shares of the whole by (cleaned) label; a label that is missing from a given target gets nothing. Where the three
    targets can't hold together, those of the sources do.

    A source that isn't listed, or whose share is 0, gives nothing; a listed source without texts can't, and the others
    keep their proportions. Texts without tokens add nothing and are not chosen. `total` lowers the size of the mix.
    """
    spark = sized.sparkSession
    t = clean_targets(targets)
    known = sized.join(F.broadcast(t.select("source")), "source", "left_semi")  # as many rows as targets are listed
    cells = known.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).toPandas()  # bounded by the folding
    r = rates(cells, t.toPandas(), total, languages, topics)
    schema = "source string, lang string, topic string, tokens bigint, rate double"
    rate = F.broadcast(spark.createDataFrame([(a, b, c, int(d), float(e)) for a, b, c, d, e in r[["source", "lang", "topic", "tokens", "rate"]].itertuples(index=False)], schema))
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    part = F.col("rate") - F.floor("rate")
    # A text occurs once more when u / part < 1; per source the 1 is moved until the tokens fit.
    v = F.least(F.when(part > 0, u / part).otherwise(F.lit(SPAN)), F.lit(SPAN))
    d = known.where("n_tokens > 0").join(rate, ["source", "lang", "topic"]).withColumn("v", v).withColumn("step", F.floor(F.col("v") * STEPS).cast("int"))
    hist = d.where(F.col("v") < SPAN).groupBy("source", "step").agg(F.sum("n_tokens").alias("w"))
    goal = d.groupBy("source").agg(F.sum(part * F.col("n_tokens")).alias("goal"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = hist.withColumn("before", before).join(goal, "source").select(
        "source", "step", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("goal") - F.col("before")) / F.col("w"))).alias("inside")
    )
    # `limits` has at most STEPS * SPAN rows per listed source.
    chosen = d.join(F.broadcast(limits), ["source", "step"], "left")
    extra = F.coalesce((F.col("v") * STEPS - F.col("step") < F.col("inside")).cast("int"), F.lit(0))
    return chosen.select("doc_id", "source", "lang", "topic", "n_tokens", (F.floor("rate").cast("int") + extra).alias("copies")).where("copies > 0")


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chosen document with its source, size and number of copies."""
    return mix(sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets")).select("doc_id", "source", "n_tokens", "copies")


def p7_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the mix and of what is at hand by source, language and topic, and how many labels stand under each (more than one where they were folded)."""
    labelled = sized_labels(table(spark, sf_dir, "documents"))
    sized = fold(labelled)
    got = cut_lineage(mix(sized, table(spark, sf_dir, "mix_targets")))
    folded = labelled.select("doc_id", F.col("source").alias("source0"), F.col("lang").alias("lang0"), F.col("topic").alias("topic0")).join(sized, "doc_id")
    out = None
    for k in ("source", "lang", "topic"):
        own = got.groupBy(k).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
        have = folded.groupBy(k).agg(F.sum("n_tokens").alias("tokens_at_hand"), F.count_distinct(k + "0").alias("labels"))
        rows = have.join(own, k, "left").select(F.lit(k).alias("marginal"), F.col(k).alias("label"), "labels", "tokens_at_hand", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"))
        out = rows if out is None else out.union(rows)
    share = lambda c: F.round(F.col(c) / F.greatest(F.sum(c).over(Window.partitionBy("marginal")), F.lit(1)), 6)
    return out.withColumn("share_at_hand", share("tokens_at_hand")).withColumn("share_mixed", share("mixed_tokens"))  # labels are bounded by the folding


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source with texts and a share: whether no text occurs too often, and whether the source's tokens are within one text of its share of the mix."""
    sized = sized_documents(table(spark, sf_dir, "documents"))
    targets = clean_targets(table(spark, sf_dir, "mix_targets")).where("target_share > 0 and max_repeats > 0")
    got = cut_lineage(mix(sized, table(spark, sf_dir, "mix_targets"))).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most"))
    largest = sized.groupBy("source").agg(F.max("n_tokens").alias("largest"), F.sum("n_tokens").alias("n")).where("n > 0")
    rows = targets.join(largest, "source").join(got, "source", "left").fillna(0)
    whole = Window.partitionBy(F.lit(1))  # one row a listed source
    goal = F.col("target_share") / F.sum("target_share").over(whole) * F.sum("mixed").over(whole)
    return rows.select("source", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("mixed") - goal) <= F.max("largest").over(whole)).alias("within_a_text"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source: its target, the share reached, its tokens in the mix and at hand, and the most copies of a text."""
    sized = sized_documents(table(spark, sf_dir, "documents"))
    targets = table(spark, sf_dir, "mix_targets")
    got = mix(sized, targets).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens_at_hand"))
    rows = clean_targets(targets).join(got, "source", "left").join(have, "source", "left").fillna(0)
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return rows.select(
        "source", "target_share", F.round(F.col("mixed_tokens") / F.greatest(total, F.lit(1)), 6).alias("actual_share"),
        "mixed_tokens", "tokens_at_hand", "max_repeats", "most_copies",
    )


QUERIES = {"p7_mixed": p7_mixed, "p7_shares": p7_shares, "p7_marginals": p7_marginals, "p7_checks": p7_checks}
_CLEAN = r"regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g')"
ORACLES = {
    "p7_checks": f"""SELECT DISTINCT {_CLEAN} AS source, true AS within_repeats, true AS within_a_text FROM mix_targets WHERE target_share > 0 AND max_repeats > 0
      AND {_CLEAN} IN (SELECT {_CLEAN} FROM documents WHERE text <> '')""",
}
