"""Compare a query with its SQL on the small tables, as multisets of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


def joins_have_keys(df) -> None:
    """No join of a plan pairs rows without a key."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def same(spark, query, sql: str, folder: str = SMALL) -> None:
    df = query(spark, folder)
    joins_have_keys(df)
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())
