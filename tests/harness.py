"""Compare a Spark result with a DuckDB result: row count, columns and values, in any row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        if math.isnan(value):
            return "∅"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, bool):
        return str(value)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences, empty when equal."""
    columns = df.columns
    got = rows_of(columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    problems = []
    if sorted(columns) != sorted(names):
        return [f"columns {sorted(columns)} vs {sorted(names)}"]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if got != want:
        a, b = set(got), set(want)
        extra, missing = sorted(a - b)[:3], sorted(b - a)[:3]
        problems.append(
            f"cols {sorted(columns)}\n  only spark ({len(a - b)}): {extra}\n  only sql ({len(b - a)}): {missing}"
        )
    return problems


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def type_differences(df, con, sql: str) -> list[str]:
    """Columns whose types differ between the two engines."""
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name}: {kind} vs {want.get(name)}" for name, kind in df.dtypes
        if _TYPES.get(kind) != want.get(name)
    ]
