"""Rows of a DataFrame against rows that DuckDB's SQL gives on the same tables, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path
from typing import Any

import duckdb


def plain(v: Any) -> Any:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if v is None or isinstance(v, bool):
        return str(v)
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return "None" if math.isnan(v) else int(v) if v == int(v) else float(f"{v:.9g}")
    return v


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str, sql: str) -> tuple[list[str], list]:
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = c.execute(sql)
    return [x[0] for x in got.description], got.fetchall()


def assert_same(df, folder: str, sql: str) -> None:
    names, rows = duck(folder, sql)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rows)
