"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import decimal
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | np.floating):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [want.columns.index(c) for c in columns]
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert rows


def test_every_query_is_there_and_the_contract_holds(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert [tuple(r) for r in entry.entry(spark).orderBy("stage").collect()][0][1] == "members"
