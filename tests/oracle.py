"""Holds a query's rows against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in x)
    if x is None or isinstance(x, (float, np.floating)) and math.isnan(x):
        return None
    return x.item() if isinstance(x, np.generic) else x


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)


def duck(sql, sf=SF):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con.sql(sql).df()


def same(a, b):
    (na, ra), (nb, rb) = rows(a), rows(b)
    assert na == nb
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            assert u == v or isinstance(u, float) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6), (x, y)
