"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from karst.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, duck, name):
    df, rel = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    got = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = Counter(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got == want


def test_entry_imports_without_the_corpus_part():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(SQL) <= set(e.oracle_sql())
