import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from karst.functions import values as V
from karst.operators.batches import Counts, isolated, watched
from karst.records import clauses, drafts, incorporation
from karst.sources.tables import Publication


@pytest.mark.parametrize(("text", "want"), [
    ("Regulation 90 of Table A, Articles of Association", "section_90"), ("Article 95 Articles of Association", "section_90"), ("Articles 95 Articles of Association", "standard"), ("Article 955 of the Articles of Association", "standard"),
    ("clause 53, CONSTITUTION", "section_90"), ("Paragraph 15 (Third Schedule)", "paragraph_15"), ("Article 34, constitution", "paragraph_15"), ("Article 34, constitution and Articles of Association", "standard"), ("Regulation 34 constitution", "paragraph_15"),
    ("Paragraph 15 Third Schedule; Clause 53 Constitution", "section_90"), (None, "standard"), ("", "standard"), ("Ａｒｔｉｃｌｅ ９ Articles of Association", "section_90"),
])
def test_families(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clauses.family(F.col("t"))).first()[0] == want


def test_balanced_lines(spark):
    texts = ["one", "one two", "a bb ccc dddd eeeee", " ", None, "x" * 61, "y" * 50 + " " + "z" * 50, "1 2", "aaaa bb aaaa", "w " * 70]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.balanced_lines(F.col("t"))).collect()]
    for t, g in zip(texts, got, strict=True):
        words = (t or "").split()
        cuts = [(" ".join(words[:i]), " ".join(words[i:])) for i in range(1, max(2, len(words)))] if words else []
        fit = [c for c in cuts if max(map(len, c)) <= 60]
        want = min(fit, key=lambda c: (max(map(len, c)), abs(len(c[0]) - len(c[1])))) if fit else None
        assert (g and (g.first, g.second)) == want and (g is None or g.compact == (max(map(len, want)) > 44))


def test_sheet_names_are_unique(spark):
    rows = spark.createDataFrame([(7, "A/B: [x]"), (7, "a b x"), (7, "A*B x"), (1234, None), (8, "n" * 40)], "k int, folder string")
    got = sorted(r.sheet for r in drafts.sheet_names(rows, "k", F.col("folder")).collect())
    assert [g.lower() for g in got] == sorted(["007 a b x", "007 a b x 2", "007 a b x 3", "1234", "008 " + "n" * 27], key=lambda x: [g.lower() for g in got].index(x)) and len({g.lower() for g in got}) == 5 and max(map(len, got)) == 31


ROSTER = "company int, slot int, Name string, `ID Type` string, `ID No` string, Nationality string, Race string, Gender string, DOB string, `Passport Expiry` string, Address string, Email string, `Contact No` string, `Business Occupation` string, Shares string, `Share Type` string"


def test_companies_are_ready_or_say_why(spark):
    full = ("MYKAD", "1", "Malaysia", "x", "male", "01/02/1980", None, "ROAD", "e@x", "1", "trader")
    member = lambda c, name="ALICE", number="1", shares="10", **k: (c, 1, name, k.get("paper", "MYKAD"), number, *full[2:5], k.get("dob", "01/02/1980"), None, k.get("address", "ROAD"), *full[8:], shares, "ORDINARY")
    director = lambda c, name="ALICE", number="1": (c, 1, name, "MYKAD", number, *full[2:], None, None)
    directors = spark.createDataFrame([director(1), director(2, "BOB"), director(3), director(5), (1, 2, "CAROL", "MYKAD", "2", *full[2:], None, None), director(6)], ROSTER)
    members = spark.createDataFrame([member(1), member(2, "ALICE"), member(3, paper="PASSPORT"), member(4), member(5, address="r" * 181), member(6, shares="-1")], ROSTER)
    owners = spark.createDataFrame([(1, "ALICE", "1", "01/01/2021", "", "X")], "company int, Name string, `ID No` string, `Date of Becoming BO` string, `Date of Cessation` string, `Criteria C` string")
    company = lambda c, day="01/01/2020": (c, "TEST", "R", day, "A", "B")
    companies = spark.createDataFrame([company(1), company(2), company(3), company(4), company(5), company(6), company(7), company(7), company(8, "")], "company int, `Company Name` string, `Reg No` string, `S14 Incorporation Date` string, `S14 Registered Address` string, `S14 Business Address` string")
    told, people = incorporation.prepare(companies, directors, members, owners)
    got = {r.company: [(i.code, i.subject) for i in r.issues] for r in told.collect()}
    assert got == {
        1: [], 2: [("conflicting_person_data", "both 1")], 3: [("missing_person_data", "member 1: Passport Expiry Date")], 4: [("missing_directors", None)], 5: [("field_over_capacity", "member 1 Residential Address")],
        6: [("invalid_total_shares", None)], 7: [("source_ambiguous", "2")], 8: [("missing_company_data", "S14 Incorporation Date")],
    }
    rows = {(r.role, r.slot): r for r in people.collect()}
    assert set(rows) == {("director", 1), ("director", 2), ("member", 1)}
    m = rows["member", 1]
    # The ownership form began after the day of incorporation, so it says nothing.
    assert (m.beneficial_owner, m.control, float(m.percentage), m.becoming, m.gender.value, m.citizenship.value, m.date_of_birth.value) == (True, False, 100.0, datetime.date(2020, 1, 1), "MALE", "MALAYSIAN", "1980-02-01")


def test_one_company_that_fails_leaves_the_others(spark):
    rows = spark.createDataFrame([(i, float(j)) for i in range(100) for j in range(3)] + [(None, 1.0)] + [(200, 0.0)] * 50, "k int, v double")

    def work(frame):
        if frame["k"].iloc[0] == 37:
            raise KeyError("poisoned")
        if frame["k"].iloc[0] == 38:
            return pd.DataFrame({"other": [1]})
        return pd.DataFrame({"total": [frame["v"].sum()]})

    got = isolated(rows, "k", work, "total double", most=40).collect()
    assert len(got) == 102 and {r.k: r.error for r in got if r.error} == {37: "KeyError: 'poisoned'", 38: got[[r.k for r in got].index(38)].error, 200: "TooLarge: 50 rows"}
    assert all(r.total == (1.0 if r.k is None else 3.0) for r in got if not r.error)


def test_many_companies_to_a_batch_are_as_if_each_came_alone(spark):
    rows = spark.createDataFrame([(k, None if (k, j) == (3, 1) else 2**60 + j) for k in (1, 2, 3, 4, None) for j in range(20 if k == 2 else 3)], "k int, v long")

    def work(frame):
        kind, frame["n"] = str(frame["v"].dtype), len(frame)
        return pd.DataFrame({"kind": [kind], "n": [frame["n"][0]], "most": [None if kind == "float64" else frame["v"].max()]})

    done = isolated(rows, "k", work, "kind string, n long, most long")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan  # a batch for each key takes longer than its work
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # so the rows of a key stand in several
    try:
        got = {r.k: (r.kind, r.n, r.most, r.error) for r in done.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = ("int64", 3, 2**60 + 2, None)
    assert got == {1: whole, 2: ("int64", 20, 2**60 + 19, None), 3: ("float64", 3, None, None), 4: whole, None: whole}


def test_counts_reach_the_caller(spark, tmp_path):
    jobs, said = [], []
    watched(spark.range(1000), lambda df: df.where("id % 3 = 0"), lambda a, b: said.append((a, b)), {"even": F.col("id") % 2 == 0})(lambda out: jobs.append(out.write.parquet(f"{tmp_path}/o")))
    assert said == [({"rows": 1000}, {"rows": 334, "even": 167})] and len(jobs) == 1
    counts = Counts({"none": F.lit(False)})
    assert counts.on(spark.range(0)).count() == 0 and counts.result() == {"rows": 0, "none": 0}


def test_tables_change_together_wherever_it_stops(spark, tmp_path):
    def tables(root):
        return [sorted(r[0] for r in spark.read.parquet(f"{root}/{t}").collect()) for t in ("a", "b")]

    stop, outcomes = 0, []
    while True:
        root = f"file://{tmp_path}/{stop}"
        spark.range(3).write.parquet(f"{root}/a")
        spark.range(2).write.parquet(f"{root}/b")
        p = Publication(spark, root)
        p.stage("a", spark.range(10, 12))
        p.stage("b", spark.range(20, 21))
        steps, done = p.steps(), 0
        for done, _ in enumerate(steps, 1):
            if done > stop:
                break
        else:
            break
        again = Publication(spark, root)  # another driver, after a crash
        new = again.recover()
        state = tables(root)
        assert state == [[10, 11], [20]] or not new and state == [[0, 1, 2], [0, 1]]
        assert not Publication(spark, root).recover() and tables(root) == state
        outcomes.append(state == [[10, 11], [20]])
        stop += 1
    assert outcomes == sorted(outcomes) and set(outcomes) == {False, True} and tables(root) == [[10, 11], [20]]
    fresh = Publication(spark, f"file://{tmp_path}/fresh")
    fresh.stage("a", spark.range(1))
    fresh.publish()
    assert spark.read.parquet(f"{tmp_path}/fresh/a").count() == 1 and fresh.recover() is False


def test_balanced_lines_split_a_text_once(spark):
    plan = spark.range(1).select(V.balanced_lines(F.concat(F.lit("a b "), F.col("id"))).alias("l")).select("l.first", "l.second", "l.compact")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
