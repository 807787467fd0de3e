"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from driftloom.plans import queries as Q

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_against_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    rows = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    if name not in Q.ORACLES:
        assert rows
        return
    rel = duck.sql(Q.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    expected = [tuple(_plain(r[k]) for k in at) for r in rel.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
