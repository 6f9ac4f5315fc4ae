"""Side-by-side comparison of a query with its SQL on the same Parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _kind(name: str) -> str:
    name = name.lower()
    return {"int": "integer", "string": "varchar", "long": "bigint", "timestamp_ntz": "timestamp"}.get(name, name)


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def differences(df, con, sql: str) -> list[str]:
    rel = con.sql(sql)
    mine = {f.name: _kind(f.dataType.simpleString()) for f in df.schema}
    theirs = {n: _kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    out = []
    if set(mine) != set(theirs):
        return [f"columns differ: {sorted(set(mine) ^ set(theirs))}"]
    out += [f"type of {c}: {mine[c]} vs {theirs[c]}" for c in mine if mine[c] != theirs[c]]
    cols = sorted(mine)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted(([_cell(r[c]) for c in cols] for r in df.select(*cols).collect()), key=key)
    order = [rel.columns.index(c) for c in cols]
    b = sorted(([_cell(r[i]) for i in order] for r in rel.fetchall()), key=key)
    if len(a) != len(b):
        out.append(f"rows: {len(a)} vs {len(b)}")
    for x, y in zip(a, b):
        if x != y:
            out.append(f"first difference: {dict(zip(cols, x))} vs {dict(zip(cols, y))}")
            break
    return out
