"""Strict comparison of a registered query with its SQL: column names, kinds, row count, all values."""
from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty means equal."""
    rel = con.sql(sql)
    names, kinds = list(rel.columns), [str(t) for t in rel.types]
    faults = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    mine = {n: KINDS.get(t, t) for n, t in df.dtypes}
    for n, k in zip(names, kinds):
        if mine[n] != k:
            faults.append(f"type of {n}: {mine[n]} vs {k}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(_plain(r[n]) for n in order) for r in df.collect())
    if sum(want.values()) != sum(got.values()):
        faults.append(f"rows {sum(got.values())} vs {sum(want.values())}")
    if want != got:
        extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
        faults.append(f"values {order}: {sum((got - want).values())} differ; ours {extra}; SQL {lost}")
    return faults
