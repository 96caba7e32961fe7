"""What a folder's filings lead to, on small histories."""

import datetime as dt

import pytest

from karst.records import rosters, state

FILING = "folder string, path string, section string, effective date, total_shares long, quality int, reference string, lodged date"
HOLDING = "folder string, path string, id_no string, name string, shares long"
EVENT = "folder string, path string, kind string, event_date date, ic string, name string, race string, appointment_date string"


def day(n):
    return dt.date(2024, 1, n)


def filings(spark, *rows):
    return spark.createDataFrame([("F", p, s, d, t, 2, "", d) for p, s, d, t in rows], FILING)


def holdings(spark, *rows):
    return spark.createDataFrame([("F", *r) for r in rows], HOLDING)


def run(spark, f, h):
    now, totals, issues = state.members(filings(spark, *f), holdings(spark, *h))
    return ([(r.key, r.shares) for r in now.orderBy("slot").collect()], [r.member_total for r in totals.collect()], sorted((r.code, r.source_path) for r in issues.collect()))


def test_allotments_add_to_the_snapshot(spark):
    got = run(spark, [("a", "S68", day(1), 100), ("b", "S78", day(2), None), ("c", "S78", day(1), None)], [("a", "1", "ALICE", 100), ("b", "2", "BOB", 50), ("c", "1", "ALICE", 7)])
    assert got == ([("ID:1", 100), ("ID:2", 50)], [150], [])


def test_a_later_register_absorbs_an_earlier_allotment(spark):
    got = run(spark, [("a", "S68", day(1), 100), ("b", "S78", day(2), None), ("c", "S51", day(3), 150)], [("a", "1", "ALICE", 100), ("b", "2", "BOB", 50), ("c", "1", "ALICE", 90), ("c", "2", "BOB", 60)])
    assert got == ([("ID:1", 90), ("ID:2", 60)], [150], [])


def test_an_invalid_snapshot_keeps_the_last_valid_one(spark):
    got = run(spark, [("a", "S68", day(1), 100), ("b", "S68", day(2), 100)], [("a", "1", "ALICE", 100), ("b", "1", "ALICE", 80)])
    assert got == ([("ID:1", 100)], [100], [("INVALID_MEMBER_SNAPSHOT", "b")])


def test_snapshots_of_one_day_that_differ(spark):
    got = run(spark, [("a", "S68", day(1), 100), ("b", "S51", day(2), 60), ("c", "S51", day(2), 70)], [("a", "1", "ALICE", 100), ("b", "1", "ALICE", 60), ("c", "1", "ALICE", 70)])
    assert got == ([("ID:1", 100)], [100], [("SAME_DATE_MEMBER_SNAPSHOT_CONFLICT", "b")])


def test_allottees_by_name_and_without_identity(spark):
    f = [("a", "S68", day(1), 100), ("b", "S78", day(2), 200), ("c", "S78", day(3), None), ("d", "S78", day(4), None)]
    got = run(spark, f, [("a", "1", "ALICE", 100), ("b", "9", "ALICE", 50), ("b", "", "", 10), ("c", "7", "EVE", 5), ("d", "8", "EVE", 6)])
    codes = [("ALLOTTEE_IDENTITY_MISSING", "b"), ("MEMBER_NAME_FALLBACK", "b"), ("MEMBER_NAME_FALLBACK", "d"), ("SHARE_RECONCILIATION", "d")]
    assert got == ([("ID:1", 150), ("ID:7", 11)], [211], codes)


def test_people_are_shuffled_by_filing_and_allotments_summed_before_they_meet_holders(spark):
    f = filings(spark, ("a", "S68", day(1), 100), *[(f"b{i}", "S78", day(2 + i), None) for i in range(9)], ("c", "S58", day(2), None), ("d", "S78", None, None))
    h = holdings(spark, ("a", "1", "ALICE", 100), *[(f"b{i}", "9" if i % 2 else "1", "ALICE", 1) for i in range(9)], ("c", "1", "ALICE", 5), ("d", "1", "ALICE", 5))
    people = state._people(f, h)
    assert people.columns == ["folder", "path", "key", "name", "shares", "section", "effective", "total_shares", "quality", "reference"] and people.count() == 10
    exchanges = [x for x in people._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert exchanges and not any("key#" in x.split("hashpartitioning(")[1].split(")")[0] for x in exchanges)
    now, totals, issues = state.members(f, h)
    given = [x for x in now.inputFiles() if "/given/" in x]
    assert given and spark.read.parquet(*given).count() == 2  # of nine allotments
    assert [(r.key, r.shares) for r in now.collect()] == [("ID:1", 109)] and [r.member_total for r in totals.collect()] == [109]
    assert sorted((r.code, r.source_path) for r in issues.collect()) == [("MEMBER_NAME_FALLBACK", f"b{i}") for i in (1, 3, 5, 7)]


def test_unparsed_allotment_and_totals(spark):
    f = filings(spark, ("a", "S68", day(1), 100), ("b", "S78", day(2), 130))
    now, totals, issues = state.members(f, holdings(spark, ("a", "1", "ALICE", 100)))
    assert [(r.code, r.source_path) for r in issues.collect()] == [("UNPARSED_ALLOTMENT", "b")]
    assert [r.total for r in state.total_shares(f, totals).collect()] == [130]
    f = filings(spark, ("a", "S68", day(1), 100), ("b", "S78", day(2), None))
    _, totals, _ = state.members(f, holdings(spark, ("a", "1", "ALICE", 100), ("b", "1", "ALICE", 5)))
    assert [r.total for r in state.total_shares(f, totals).collect()] == [105]


def test_nothing(spark):
    f, h = filings(spark, ("a", "S68", None, None)).limit(0), holdings(spark, ("a", "1", "A", 1)).limit(0)
    assert all(x.collect() == [] for x in state.members(f, h))
    assert state.companies(f, state.total_shares(f, state.members(f, h)[1]))[0].collect() == []


def officers(spark, snapshot, *events):
    f = filings(spark, ("s", "S68", day(5), None), *[(f"e{i}", "S58", day(9), None) for i in range(len(events))])
    o = spark.createDataFrame([("F", "s", *x) for x in snapshot], "folder string, path string, ic string, name string")
    e = spark.createDataFrame([("F", f"e{i}", *x) for i, x in enumerate(events)], EVENT)
    now, issues = state.directors(f, o, e)
    return [(r.key, r.name, r.race) for r in now.orderBy("slot").collect()], sorted((r.code, r.source_path) for r in issues.collect())


def test_events_in_order(spark):
    got = officers(
        spark, [("1", "ALICE"), ("2", "BOB")],
        ("APPOINT", day(7), "3", "CAROL", "X", "06/01/2024"), ("CEASE", day(6), "2", "BOB", None, None), ("CEASE", day(4), "1", "ALICE", None, None), ("UPDATE", day(5), "1", None, "Y", None), ("APPOINT", None, "4", "DAVE", None, None),
    )
    assert got == ([("ID:1", "ALICE", "Y"), ("ID:3", "CAROL", "X")], [("UNDATED_DIRECTOR_EVENT", "e4")])


def test_conflict_of_one_day_changes_nothing(spark):
    got = officers(spark, [("1", "ALICE")], ("CEASE", day(6), "1", "ALICE", None, None), ("APPOINT", day(6), "1", "ALICE", "Z", None))
    assert got == ([("ID:1", "ALICE", "")], [("SAME_DATE_DIRECTOR_CONFLICT", "e0")])


def test_another_number_for_the_only_one_of_a_name(spark):
    got = officers(spark, [("1", "ALICE"), ("2", "BOB")], ("UPDATE", day(6), "9", "ALICE", None, None), ("CEASE", day(7), "8", "BOB", None, None), ("CEASE", day(8), "", "", None, None))
    assert got == ([("ID:9", "ALICE", "")], [("DIRECTOR_IDENTITY_MISSING", "e2"), ("DIRECTOR_NAME_FALLBACK", "e0"), ("DIRECTOR_NAME_FALLBACK", "e1")])


def test_unread_events(spark):
    from pyspark.sql import functions as F

    f = filings(spark, ("a", "S58", day(1), None), ("b", "S58", day(1), None), ("c", "S58", day(1), None)).withColumn("expected", F.lit(2))
    e = spark.createDataFrame([("F", "b", "APPOINT"), ("F", "c", "CEASE"), ("F", "c", "APPOINT")], "folder string, path string, kind string")
    assert sorted((r.code, r.source_path) for r in state.unread_events(f, e).collect()) == [("PARTIAL_DIRECTOR_EVENT_PARSE", "b"), ("UNPARSED_DIRECTOR_FILING", "a")]


@pytest.mark.parametrize("parser", [rosters.members_s51, rosters.new_directors_s58, rosters.directors_s68, rosters.members_s68])
def test_texts_without_a_register(spark, parser):
    files = spark.createDataFrame([("a", None), ("b", ""), ("c", "PARTICULAR OF SHAREHOLDERS SECTION E DIRECTOR"), ("d", "1 2 3 4")], "path string, text string")
    assert parser(files).collect() == []
