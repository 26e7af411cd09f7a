"""Order-insensitive comparison of a Spark result with DuckDB on the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if type(v).__name__ == "Decimal":
        return _norm(int(v)) if v == int(v) else _norm(float(v))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> list[str]:
    got = df.collect()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return [f"rows {len(a)} vs {len(b)}"] + [f"spark only {x}" for x in list(set(a) - set(b))[:3]] + [f"sql only {x}" for x in list(set(b) - set(a))[:3]]
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return [f"{len(bad)} rows differ; {x} vs {y}" for x, y in bad[:3]]


SF = os.environ.get("WELLGRID_TEST_SF", "/root/testdata/sf0.001")
