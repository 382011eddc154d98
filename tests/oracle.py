"""Runs a query's SQL in DuckDB over the same tables, and compares rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return repr(v)


def same_rows(df, con, sql):
    """None, or what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    kinds = dict(zip(names, (str(c[1]).upper() for c in result.description)))
    order = sorted(names)
    theirs = result.fetchall()
    at = [names.index(c) for c in order]
    theirs = sorted(tuple(_key(r[i]) for i in at) for r in theirs)
    ours = sorted(tuple(_key(r[c]) for c in order) for r in df.collect())
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}"
    spark = {"bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "boolean": "BOOLEAN", "string": "VARCHAR", "float": "FLOAT"}
    odd = [(c, k, kinds[c]) for c, k in df.dtypes if spark.get(k, k) != kinds[c] and kinds[c] not in ("NUMBER", "STRING", "BOOL")]
    return f"types {odd}" if odd else None
