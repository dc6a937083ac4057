"""Runs a query and its reference SQL and compares the rows."""

from __future__ import annotations

import duckdb

from assayer.catalogue.tables import TABLES

# Spark type -> DuckDB types that hold the same values.
SAME = {
    "bigint": ("BIGINT",),
    "int": ("INTEGER",),
    "double": ("DOUBLE",),
    "string": ("VARCHAR",),
    "boolean": ("BOOLEAN",),
    "timestamp_ntz": ("TIMESTAMP",),
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _key(value):
    if value is None:
        return "\0"
    if isinstance(value, float):
        return f"{value:.5g}"
    return str(value)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b


def differences(df, db, sql: str) -> list[str]:
    names = sorted(df.columns)
    result = db.execute(sql)
    described = {d[0]: str(d[1]) for d in result.description}
    problems = []
    if sorted(described) != names:
        return [f"columns {names} != {sorted(described)}"]
    kinds = dict(df.dtypes)
    for name in names:
        if described[name].upper() not in [k.upper() for k in SAME.get(kinds[name], ())]:
            problems.append(f"{name}: {kinds[name]} != {described[name]}")
    order = [d[0] for d in result.description]
    theirs = [tuple(row[order.index(n)] for n in names) for row in result.fetchall()]
    ours = [tuple(row[n] for n in names) for row in df.select(*[f"`{n}`" for n in names]).collect()]
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
        return problems
    for a, b in zip(sorted(ours, key=lambda r: [_key(v) for v in r]), sorted(theirs, key=lambda r: [_key(v) for v in r])):
        if not all(_close(x, y) for x, y in zip(a, b)):
            problems.append(f"{str(a)[:300]} != {str(b)[:300]}")
            break
    return problems
