"""Queries whose SQL is cut, against the whole of the smallest tables."""

import os

import duckdb
import pytest

from karst.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(sql):
    return sorted(duckdb.sql(sql).fetchall(), key=repr)


def test_slots_hold_every_line(spark):
    want = rows(f"SELECT l_orderkey, l_linenumber::INT, max(l_partkey), max(l_quantity) FROM '{DATA}/lineitem.parquet' GROUP BY 1, 2")
    df = QUERIES["unpivot_slots"](spark, DATA)
    assert sorted(map(tuple, df.select("l_orderkey", "slot", "Name", "Shares").collect()), key=repr) == want
    wide = QUERIES["pivot_slots"](spark, DATA)
    most = max(r[1] for r in want)
    assert most > 4 and wide.columns == ["l_orderkey", *[f"Member{n} {f}" for n in range(1, most + 1) for f in ("Name", "Shares")]]
    got = [(r[0], n, r[f"Member{n} Name"], r[f"Member{n} Shares"]) for r in wide.collect() for n in range(1, most + 1) if r[f"Member{n} Name"] is not None]
    assert sorted(got, key=repr) == want


def test_every_line_of_every_item_is_a_name(spark):
    from pyspark.sql import functions as F

    from karst.functions import text as T

    key = lambda t: [(r[0], r[1].split(" ")) for r in t.select(t.columns[0], T.name_key(F.col(t.columns[1]))).collect() if r[1]]
    plain = set("SDN BHD BERHAD PRIVATE LIMITED LTD COMPANY CO MALAYSIA M".split())
    lines = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", F.explode(F.split("text", "\n")))
    names = {" ".join(w): {x for x in w if len(x) > 1} - plain for _, w in key(lines)}
    want = {}
    for doc, words in key(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")):
        words = set(words)
        hits = sorted(((len(tk), len(n)), n) for n, tk in names.items() if tk and tk <= words and (len(tk) > 1 or len(n) >= 5))
        top = [n for s, n in hits if s == hits[-1][0]]
        if len(top) == 1:
            want[doc] = top[0]
    assert want and dict(map(tuple, QUERIES["token_subset_match"](spark, DATA).collect())) == want


def test_no_row_is_left_out_by_its_id(spark):
    got = [tuple(r) for r in QUERIES["active_sorted"](spark, DATA).select("c_custkey", "active").collect()]
    assert got == duckdb.sql(f"SELECT c_custkey, c_acctbal > 0 FROM '{DATA}/customer.parquet' ORDER BY c_name NULLS LAST, c_custkey").fetchall()
    got = QUERIES["person_associations"](spark, DATA).select("person", "company", "roles").collect()
    want = rows(f"""
        SELECT person, company, list(role ORDER BY n) FROM (
            SELECT DISTINCT l_suppkey AS person, l_orderkey AS company, l_linenumber AS n,
                CASE l_linenumber WHEN 1 THEN 'Director' WHEN 2 THEN 'Shareholder' ELSE 'Role ' || l_linenumber END AS role FROM '{DATA}/lineitem.parquet')
        GROUP BY 1, 2""")
    assert sorted(map(tuple, got), key=repr) == want


def test_every_part_name_is_asked_for(spark, tmp_path):
    spark.createDataFrame([(i, f"part {i}", "none") for i in range(1, 15)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.p_partkey for r in QUERIES["guarded_name_lookup_many"](spark, str(tmp_path)).collect()} == set(range(1, 15))
