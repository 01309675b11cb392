"""The corpus queries beside their SQL: on the smallest tables, and those on documents alone also on awkward rows."""

import math
import os

import duckdb
import pytest

from millrace.llm import queries, quality_rules, sharding
from tests.llm.test_operators import DOCS, ODD, SF

SQL = queries.oracle_sql()
ON_DOCUMENTS = {"op4_quality_rules": quality_rules.op4_quality_rules, "op10_sharding": sharding.op10_sharding}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, con, sql):
    cols = sorted(df.columns)
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_corpus_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    same(queries.queries()[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
@pytest.mark.parametrize("rows", [ODD, [(10 + i, None if i % 5 == 0 else "the quick #brown fox, of 7 days\n" * (i + 1) + f"Zürich {i}", "en" if i % 3 else None, f"s{i % 2}", i) for i in range(40)]])
def test_sql_of_awkward_rows(spark, name, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    same(ON_DOCUMENTS[name](spark.createDataFrame(rows, DOCS)), con, SQL[name])
