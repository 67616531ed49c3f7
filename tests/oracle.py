"""Compare queries with their SQL on a data folder: python tests/oracle.py FOLDER [NAME...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings detect_runs tokenized_files windows blocks clone_instances fuzzy_matches clones file_stats pack_specs mix_targets".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    return str(v) if v is not None else "~"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf, name, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if ours is not None else "?"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}; ours {ours[:2]} theirs {theirs[:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as e
    from echotrace.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf, only = sys.argv[1], sys.argv[2:]
    qs, os_ = e.queries(), e.oracle_sql()
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            r = compare(spark, sf, name, fn, os_.get(name))
        except Exception as x:
            r = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{'ok  ' if r is None else 'BAD '} {'sql' if name in os_ else '---'} {time.time() - t:6.1f}s {name} {r or ''}", flush=True)
