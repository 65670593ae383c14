"""Compare a Spark result with DuckDB's answer to the reference SQL, as multisets of rows."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir, threads=4):
    con = duckdb.connect(config={"threads": threads})
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple("" if v is None else round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else str(v) for v in row)


def differences(df, con, sql):
    """(columns differ or None, rows only in Spark, rows only in DuckDB), columns sorted by name."""
    rel = con.sql(sql)
    ours, theirs = sorted(df.columns), sorted(rel.columns)
    if ours != theirs:
        return (ours, theirs), [], []
    a = Counter(_key(r) for r in df.select(*ours).collect())
    b = Counter(_key(r) for r in con.sql(f"SELECT {', '.join(ours)} FROM ({sql})").fetchall())
    return None, list((a - b).elements())[:3], list((b - a).elements())[:3]
