"""Every registered query outside the training-data subpackage against its SQL, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = [m for m in entry._modules() if m.__name__.startswith("locus.plans.")]
QUERIES = {k: v for m in MODULES for k, v in m.queries().items()}
SQL = {k: v for m in MODULES for k, v in m.oracle_sql().items()}


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = Counter(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    want = Counter(repr(tuple(plain(r[columns.index(c)]) for c in order)) for r in cursor.fetchall())
    assert got == want


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
