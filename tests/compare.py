"""Run a registered query and its SQL twin and compare schema and values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT", "timestamp": "TIMESTAMP",
    "float": "FLOAT",
}


def differences(df, con, sql) -> list[str]:
    """Empty when row count, names, types and values agree."""
    rel = con.sql(sql)
    problems = []
    want_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    got_types = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if got_types != want_types:
        problems.append(f"schema: spark {got_types} sql {want_types}")
    gn, got = _rows(df.columns, df.collect())
    wn, want = _rows(rel.columns, rel.fetchall())
    if len(got) != len(want):
        problems.append(f"rows: spark {len(got)} sql {len(want)}")
    if gn == wn and got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        problems.append(f"values: {len(bad)} rows differ, first spark {bad[0][0] if bad else None} sql {bad[0][1] if bad else None}")
    return problems
