"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import pytest

from newstide.plans.catalog import ORACLES, QUERIES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
