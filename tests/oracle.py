"""Spark result against DuckDB result: same columns, same rows whatever their order."""

from __future__ import annotations

import os

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{round(x, 6) + 0.0:.6g}"
    if isinstance(x, bool) or x is None:
        return repr(x)
    if isinstance(x, int):
        return f"{float(x):.6g}" if abs(x) < 10**6 else str(x)
    if isinstance(x, (list, tuple)):
        return repr([_cell(y) for y in x])
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def difference(df, con, sql: str) -> str:
    """An empty text if both agree, else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want, got = rows(names, cur.fetchall()), rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, wanted {sorted(names)}"
    if want != got:
        extra, missing = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} rows, wanted {len(want)}; only here {extra}; only there {missing}"
    return ""
