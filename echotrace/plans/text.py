"""Sliding windows, repeated windows and groups of equal texts over documents, as plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators.skew import HOT_PARTS, salted_lookup
from ..session import cut_lineage, table

#: Words per window.
K = 20


def words(text: Column) -> Column:
    """Words of a text; blanks around them don't matter."""
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def windows(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, pos, h): hash of every window of k words; shorter texts have none. Hashes stay inside the engine."""
    t = docs.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("t")).where(F.size("t") >= k)
    h = F.expr(f"transform(sequence(1, size(t) - {k - 1}), i -> xxhash64(slice(t, i, {k})))")
    return t.select("doc_id", F.posexplode(h).alias("pos", "h"))


def repeated(w: DataFrame) -> DataFrame:
    """The windows whose hash occurs at two places or more: hashes are counted first, and hot ones salted when they are looked up."""
    w = cut_lineage(w)
    many = cut_lineage(w.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = many.agg(F.sum("n")).first()[0] or 0
    hot = many.where(F.col("n") > max(1, total // HOT_PARTS)).select("h")
    return salted_lookup(w, many.select("h"), "h", hot, F.xxhash64("doc_id", "pos"), "inner")


def window_hash_repeated(spark, sf_dir):
    return repeated(windows(table(spark, sf_dir, "documents"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("repeated_windows"))


def runs_of(w: DataFrame) -> DataFrame:
    """(doc_id, start_pos, windows): maximal runs of adjacent repeated windows."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    g = w.select("doc_id", "pos", (F.col("pos") - F.row_number().over(by)).alias("g"))
    return g.groupBy("doc_id", "g").agg(F.min("pos").alias("start_pos"), F.count(F.lit(1)).alias("windows")).drop("g")


def candidate_runs(spark, sf_dir):
    return runs_of(repeated(windows(table(spark, sf_dir, "documents"))))


def dup_words_per_document(spark, sf_dir):
    """Words of each document under a repeated window, and their share of it in per cent to one decimal."""
    docs = table(spark, sf_dir, "documents")
    r = runs_of(repeated(windows(docs)))
    # Two runs less than K apart share words: the overlap is counted once.
    by = Window.partitionBy("doc_id").orderBy("start_pos")
    end = F.col("start_pos") + F.col("windows") + K - 1
    cover = r.select("doc_id", end.alias("end"), F.greatest("start_pos", F.coalesce(F.lag(end).over(by), F.lit(0))).alias("from"))
    dup = cover.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("from")).cast("bigint").alias("dup_words"))
    n = docs.select("doc_id", F.size(words(F.col("text"))).alias("n_words"))
    return dup.join(n, "doc_id").select("doc_id", "n_words", "dup_words", F.round(F.col("dup_words") * 1000 / F.col("n_words"), 0).__truediv__(10).alias("dup_pct"))


def scope_windows(spark, sf_dir):
    """Windows per document whose words are all in scope: out of scope is what stands in brackets of any kind."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "w"))
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, K - 1)
    ok = t.select("doc_id", F.count(F.lit(1)).over(by).alias("n"), F.min((~F.col("w").rlike(r"[\[\](){}]")).cast("int")).over(by).alias("in_scope"))
    return ok.where((F.col("n") == K) & (F.col("in_scope") == 1)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows_in_scope"))


def _norm(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "9"), r"\s+", " "))


def exact_text_groups(spark, sf_dir):
    """Groups of two or more documents equal but for case, digits and blanks; type-1 when they are equal to the letter."""
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.md5("text").alias("raw"), F.md5(_norm(F.col("text"))).alias("h"))
    g = d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("n > 1")
    return g.select("first_doc", F.col("n").alias("instances"), F.when(F.col("lo") == F.col("hi"), "type-1").otherwise("type-2").alias("clone_type"))


def drop_overlapping_starts(spark, sf_dir):
    """Of the repeated windows of a document, in order, those that begin at or after the end of the last one kept."""
    r = repeated(windows(table(spark, sf_dir, "documents"))).groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    start = F.struct(F.lit(-K).alias("last"), F.lit(0).alias("n"))
    kept = F.aggregate("p", start, lambda a, x: F.when(x >= a["last"] + K, F.struct(x.alias("last"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])
    return r.select("doc_id", kept.alias("kept"))


def usage_words(spark, sf_dir):
    """Words that start a document of a language and occur in no other document of it: the reach predicate as an anti-join."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.lower("lang"), F.lit("")).alias("l"), F.expr("regexp_extract_all(lower(text), '[a-z][a-z0-9_]+', 0)").alias("w"))
    defs = d.where(F.size("w") > 0).select("doc_id", "l", F.col("w")[0].alias("name"))
    uses = d.select(F.col("doc_id").alias("user"), "l", F.explode("w").alias("name")).distinct()
    reached = defs.join(uses, ["l", "name"]).where("user <> doc_id").select("doc_id", "name").distinct()
    return defs.select("doc_id", "name").join(reached, ["doc_id", "name"], "left_anti")


def events_churn(spark, sf_dir):
    """Events per user in the last 90 days of the log, most first: the commit count over an event table."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    recent = e.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 90 DAYS"))
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("commits"))


_W = rf"""w0 AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS t FROM documents),
  w AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(t[i : i + {K - 1}], ' ')) AS h FROM (SELECT doc_id, t, unnest(range(1, len(t) - {K} + 2)) AS i FROM w0 WHERE len(t) >= {K})),
  r AS (SELECT doc_id, pos FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
  g AS (SELECT doc_id, min(pos) AS start_pos, count(*) AS windows FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM r) GROUP BY doc_id, g)"""
_NORM = r"md5(lower(regexp_replace(regexp_replace(text, '[0-9]+', '9', 'g'), '\s+', ' ', 'g')))"
_FUNCS = (window_hash_repeated, candidate_runs, dup_words_per_document, scope_windows, exact_text_groups, drop_overlapping_starts, usage_words, events_churn)
QUERIES = {f.__name__: f for f in _FUNCS}
ORACLES = {
    "window_hash_repeated": f"WITH {_W} SELECT doc_id, count(*) AS repeated_windows FROM r GROUP BY 1",
    "candidate_runs": f"WITH {_W} SELECT doc_id, CAST(start_pos AS INTEGER) AS start_pos, windows FROM g",
    "dup_words_per_document": f"""WITH {_W}, c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(start_pos, start_pos + windows + {K - 1})) AS p FROM g))
      SELECT doc_id, CAST(len(t) AS INTEGER) AS n_words, n AS dup_words, round(n * 1000 / len(t), 0) / 10 AS dup_pct FROM (SELECT doc_id, count(*) AS n FROM c GROUP BY 1) JOIN w0 USING (doc_id)""",
    "scope_windows": rf"""WITH {_W} SELECT doc_id, count(*) AS windows_in_scope FROM (SELECT doc_id, t, unnest(range(1, len(t) - {K} + 2)) AS i FROM w0 WHERE len(t) >= {K})
      WHERE NOT regexp_matches(array_to_string(t[i : i + {K - 1}], ' '), '[\[\](){{}}]') GROUP BY 1""",
    "exact_text_groups": f"""SELECT min(doc_id) AS first_doc, count(*) AS instances, CASE WHEN count(DISTINCT md5(text)) = 1 THEN 'type-1' ELSE 'type-2' END AS clone_type
      FROM documents WHERE text <> '' GROUP BY {_NORM} HAVING count(*) > 1""",
    "drop_overlapping_starts": f"""WITH RECURSIVE {_W}, k(doc_id, pos, n) AS (SELECT doc_id, min(pos), 1 FROM r GROUP BY 1
      UNION ALL SELECT k.doc_id, (SELECT min(r.pos) FROM r WHERE r.doc_id = k.doc_id AND r.pos >= k.pos + {K}), k.n + 1 FROM k WHERE k.pos IS NOT NULL)
      SELECT doc_id, CAST(max(n) AS INTEGER) AS kept FROM k WHERE pos IS NOT NULL GROUP BY 1""",
    "usage_words": """WITH d AS (SELECT doc_id, coalesce(lower(lang), '') AS l, regexp_extract_all(lower(text), '[a-z][a-z0-9_]+') AS w FROM documents),
      u AS (SELECT l, name, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, l, unnest(w) AS name FROM d) GROUP BY 1, 2)
      SELECT doc_id, w[1] AS name FROM d JOIN u ON u.l = d.l AND u.name = w[1] WHERE len(w) > 0 AND n = 1""",
    "events_churn": "SELECT user_id, count(*) AS commits FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 90 DAY GROUP BY 1",
}
