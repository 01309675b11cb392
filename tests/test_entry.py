"""The entry points, and every registered flow query beside its oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at)) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
