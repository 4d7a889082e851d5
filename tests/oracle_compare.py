"""Run a registered query in Spark and its SQL in DuckDB and compare all values."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in order) for r in data]
    return [columns[i] for i in order], sorted(rows, key=repr)


def differences(spark, con, name, function, statement, sf_dir) -> str | None:
    left = function(spark, sf_dir)
    a_cols, a = rows_of(left.columns, [tuple(r) for r in left.collect()])
    cursor = con.execute(statement)
    b_cols, b = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if a_cols != b_cols:
        return f"{name}: columns {a_cols} / {b_cols}"
    if len(a) != len(b):
        return f"{name}: rows {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y or [type(v) for v in x] != [type(v) for v in y]:
            return f"{name}: {str(x)[:300]} / {str(y)[:300]}"
    return None
