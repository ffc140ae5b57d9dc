"""Run a registered query and its SQL twin and compare them row by row."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def table(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, type(x).__name__, str(x)) for x in r))


def diff(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    got_cols = df.columns
    got = table(got_cols, df.collect())
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    want = table(want_cols, res.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: cols {sorted(got_cols)}; {bad[0][0]} != {bad[0][1]}"
    return None
