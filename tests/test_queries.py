"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from cubeloom.queries import load

NAMES = sorted(load().queries)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    frame = load().queries[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    if name not in load().sql:
        return
    want = con.sql(load().sql[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
