import pytest
from pyspark.sql import functions as F

from karst.operators import extract, ledger, people, reshape, vectors
from karst.operators.latest import canonical_value, latest_state, nearest
from karst.operators.lookup import by_shared_registration, guarded_lookup, guarded_lookup_many
from karst.sources.tables import key_value_sheet, read_aliases, require, upsert_table, write_verified


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


NAMES = [(1, "ALPHA ONE"), (2, "ALPHA TWO"), (3, "BETA"), (4, "BETA MAX"), (5, "GAMMA RAY")]


@pytest.mark.parametrize(("term", "want"), [("BETA", [3]), ("ALPHA", []), ("GAMMA", [5]), ("ZETA", []), ("", [])])
def test_guarded_lookup(spark, term, want):
    df = spark.createDataFrame(NAMES, "i int, k string")
    assert [r.i for r in guarded_lookup(df, F.col("k"), term).collect()] == want
    terms = spark.createDataFrame([(term,)], "t string")
    assert [r.i for r in guarded_lookup_many(df, "k", terms, "t").collect()] == want


def test_guarded_lookup_of_nothing(spark):
    assert guarded_lookup(spark.createDataFrame([], "k string"), F.col("k"), "A").collect() == []


def test_renamed_entities_share_a_registration(spark):
    df = spark.createDataFrame([("OLD", "202001000001"), ("NEW", "202001000001 (123456-A)"), ("OTHER", "202001000009")], "n string, r string")
    assert rows(by_shared_registration(df, df.where("n = 'OLD'"), "r"), "n") == [("NEW",), ("OLD",)]


def test_filter_comes_after_ranking(spark):
    df = spark.createDataFrame([("a", 1, "NEW"), ("a", 2, "END"), ("b", 1, "NEW")], "k string, t int, s string")
    assert rows(latest_state(df, ["k"], [F.desc("t")], F.col("s") == "END"), "k") == [("b",)]


def test_mode_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([("a", "y", 1), ("a", "x", 2), ("a", "x", 3), ("a", "y", 4), ("a", " ", 0), ("a", None, 0)], "k string, v string, o int")
    assert rows(canonical_value(df, "k", "v", "o"), "k", "v", "n") == [("a", "y", 2)]


def test_nearest_prefers_the_later_date(spark):
    df = spark.sql("select 1 k, date'2024-01-08' d union all select 1, date'2024-01-12' union all select 1, null")
    got = nearest(df, ["k"], F.col("d"), F.lit("2024-01-10").cast("date"), [F.asc("d")]).first()
    assert str(got.d) == "2024-01-12"


def test_slots_stop_at_the_first_missing_column(spark):
    df = spark.createDataFrame([("c", "A", "1", " ", "2", "Z")], "`Company` string, `Director1 Name` string, `Director1 IC` string, `Director2 Name` string, `Director2 IC` string, `Director4 Name` string")
    assert rows(reshape.unpivot_slots(df, "Director", "Name", ["Company"]), "Company", "slot", "Name", "IC") == [("c", 1, "A", "1")]
    assert reshape.unpivot_slots(df, "Member", "Name", ["Company"]).count() == 0


def test_upsert_overwrites_whole_rows(spark):
    a, b = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "k int, v string, w string"), spark.createDataFrame([(2, "z"), (3, "n")], "k int, v string")
    assert sorted(map(tuple, reshape.upsert(a, b, "k").collect())) == [(1, "x", "p"), (2, "z", None), (3, "n", None)]


def test_members_strictly_after_directors_from_the_day(spark):
    snap = spark.sql("select 'c' k, 'A' s, 100L n, date'2024-01-10' d union all select 'c', 'A', 5L, date'2023-01-01'")
    more = spark.sql("select 'c' k, 'A' s, 50L n, date'2024-01-11' d union all select 'c', 'A', 7L, date'2024-01-10' union all select 'e', 'B', 1L, date'2024-01-01'")
    assert rows(ledger.snapshot_plus_changes(snap, more, "k", "s", "n", "d"), "k", "s", "n") == [("c", "A", 150), ("e", "B", 1)]
    ev = spark.sql("select 'c' k, 'B' s, 'APPOINT' kind, date'2024-01-10' d union all select 'c', 'A', 'CEASE', date'2024-01-09' union all select 'c', 'C', 'APPOINT', date'2024-02-01' union all select 'c', 'C', 'CEASE', date'2024-02-01' union all select 'c', 'D', 'APPOINT', date'2024-02-01' union all select 'c', 'D', 'CEASE', date'2024-02-02'")
    assert rows(ledger.snapshot_plus_events(snap, ev, "k", "s", "d", "kind", [F.asc("kind")]), "k", "s") == [("c", "A"), ("c", "B")]


def test_shares_add_up(spark):
    df = spark.createDataFrame([("c", i, 1) for i in range(3)], "k string, i int, w int")
    assert [r.cents for r in ledger.allocate(df, "k", [F.asc("i")], "w", F.lit(100.0), "cents").orderBy("i").collect()] == [3333, 3333, 3334]


def test_duplicates_keep_blank_keys(spark):
    df = spark.createDataFrame([(1, "h"), (2, "h"), (3, ""), (4, ""), (5, None)], "i int, h string").withColumn("status", F.lit("VALID"))
    assert [r.status for r in ledger.keep_best(df, ["h"], [F.desc("i")]).orderBy("i").collect()] == ["DUPLICATE", "VALID", "VALID", "VALID", "VALID"]


def test_majority_ties_go_to_the_latest(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "", 3)], "k string, v string, o int")
    assert rows(ledger.quarantine(df, "k", "v", F.col("o")), "v", "ok") == [("", True), ("x", False), ("y", True)]


def test_people_match_by_identity_then_unique_name(spark):
    left = spark.createDataFrame([(1, "I1", "A"), (2, "", "B"), (3, "", "C"), (4, "I9", "D")], "n int, i string, m string")
    right = spark.createDataFrame([("I1", "X", "one"), ("", "B", "two"), ("", "C", "three"), ("I3", "C", "four"), ("I9", "E", "five"), ("I9", "D", "six")], "i string, m string, v string")
    got = dict(rows(people.match_people(left, right, "n", "i", "m", "v"), "n", "v"))
    assert got == {1: "one", 2: "two", 3: None, 4: "six"}


def test_reconcile_names_the_fault(spark):
    parts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", -1), ("e", 1)], "k string, n int")
    totals = spark.createDataFrame([("a", 3), ("b", 6), ("c", -1), ("d", 1)], "k string, t int")
    assert rows(ledger.reconcile(parts, totals, "k", "n", "t"), "k", "issue") == [("b", "MISMATCH"), ("c", "NEGATIVE"), ("d", "PARTS_MISSING"), ("e", "TOTAL_MISSING")]


def test_vector_threshold_and_context(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x" * 2000), (2, [0.0, 1.0], "b"), (3, [1.0, 1.0], "c"), (4, [0.0, 0.0], "d")], "i int, v array<float>, t string")
    top = vectors.top_k(df, "v", [1.0, 0.0], 3, "i", least=0.7)
    assert [r.i for r in top.collect()] == [1, 3]
    assert vectors.context(top, "t", [-F.col("score")]).first()[0] == "x" * 1500 + "\n\nc"


def test_extract(spark):
    df = spark.createDataFrame([("Name : Alice Tan  ID: 12\nX START a b END c",)], "t string")
    got = df.select(extract.labelled(F.col("t"), "Name", ("ID",)), extract.labelled(F.col("t"), "ID"), extract.labelled(F.col("t"), "Age"), extract.section(F.col("t"), "START", ("END",))).first()
    assert tuple(got) == ("Alice Tan", "12", None, " a b ")
    assert [r.block for r in extract.blocks(spark.createDataFrame([("p#a#b",), (None,)], "t string"), "t", "#").collect()] == ["a", "b"]


def test_verified_write_and_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    write_verified(df, path)
    upsert_table(spark, path, spark.createDataFrame([(2, "c")], "k int, v string"), "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        upsert_table(spark, path, spark.createDataFrame([(2, "c"), (2, "d")], "k int, v string"), "k")


def test_required_columns_and_sheets(spark):
    df = spark.createDataFrame([("s", "Name", "A"), ("s", "No", "1"), ("t", "Name", "B")], "sheet string, label string, value string")
    with pytest.raises(ValueError):
        require(df, ["nope"])
    assert rows(key_value_sheet(df, "sheet", "label", "value", ["Name", "No"]), "sheet", "Name", "No") == [("s", "A", "1"), ("t", "B", None)]
    al = spark.createDataFrame([("X", ["a", "b"]), ("Y", ["b"])], "entity string, aliases array<string>")
    with pytest.raises(Exception, match="alias of several"):
        read_aliases(al).collect()
