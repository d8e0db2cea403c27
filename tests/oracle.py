"""Runs a registered query and its SQL, and compares rows, columns by name, in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir: str, run, sql: str) -> str | None:
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = views(sf_dir)
    names = [r[0] for r in con.execute(f"describe {sql}").fetchall()]
    want = rows_of(names, con.execute(sql).fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        only, less = [r for r in got if r not in want][:3], [r for r in want if r not in got][:3]
        return f"{len(got)} and {len(want)} rows; only here {only}, only in SQL {less}"
    return None
