"""Runs a query in Spark and its SQL in DuckDB over one data folder, and compares rows without order."""

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, query, sql, sf_dir, con=None):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = (con or duck(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols, f"columns: {cols} in Spark, {sorted(names)} in SQL"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want), f"rows: {len(got)} in Spark, {len(want)} in SQL"
    for a, b in zip(got, want):
        assert a == b, f"{cols}: {a} in Spark, {b} in SQL"
    return len(got)
