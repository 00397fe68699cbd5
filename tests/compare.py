"""Rows of a Spark query against rows of DuckDB SQL, whatever their order."""

import glob
import math
import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


def same(df, con, sql):
    rows, cols = df.collect(), sorted(df.columns)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    a = sorted(str([plain(r[c]) for c in cols]) for r in rows)
    b = sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
    assert len(a) == len(b)
    assert a == b
    return len(a)
