import datetime as dt

import pytest
from pyspark.sql import functions as F

from karst.records import contexts, filings, owners
from karst.records.companies import Companies
from karst.records.registers import AUDITOR, CONSTITUTION, Auditors, Register


def col(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


@pytest.fixture(scope="module")
def companies(spark):
    rows = [
        (1, "F1", "TEST ALPHA SDN. BHD.", "202001000001", "2024-01-01", "ALICE", "800101011234", "BOB", "", "ALICE", "100"),
        (2, "F2", "TEST BETA SDN. BHD.", "", "2024-02-01", "", "", "ALICE", "800101011234", "CAROL", "50"),
        (3, "F3", "Test Beta Sdn Bhd", "", "2024-03-01", "DAVE", "", None, None, None, None),
    ]
    schema = "n int, Folder string, `Company Name` string, `Reg No` string, `Annual Return Date` string, `Director1 Name` string, `Director1 IC` string, `Director2 Name` string, `Director2 IC` string, `Member1 Name` string, `Member1 Shares` string"
    docs = spark.createDataFrame([(1, "F1", "a.pdf"), (2, "F2", "b.pdf")], "n int, Folder string, SourcePath string")
    return Companies(spark.createDataFrame(rows, schema), "n", {"documents": docs})


def test_companies(companies):
    assert col(companies.names(), "Company Name") == ["TEST ALPHA SDN. BHD.", "TEST BETA SDN. BHD."]
    assert col(companies.company("alpha"), "Folder") == ["F1"]
    assert col(companies.company("test"), "Folder") == []
    assert companies.information(["Reg No", "Reg No", "Nope"], "alpha").columns == ["Company Name", "Reg No"]
    assert companies.information(["Nope"]).count() == 0
    assert col(companies.directors("alpha"), "slot", "Name") == [(1, "ALICE"), (2, "BOB")]
    assert col(companies.directors(), "Name") == ["ALICE", "BOB", "ALICE", "DAVE"]
    assert col(companies.shareholders(), "Name", "Shares") == [("ALICE", "100"), ("CAROL", "50")]
    assert col(companies.directorships("alice"), "Reg No") == ["202001000001", ""]
    assert col(companies.shareholdings("Alice"), "Status") == ["Current"]
    assert col(companies.associations("ALICE"), "Company Name", "Roles") == [("TEST ALPHA SDN. BHD.", ["Director", "Shareholder"]), ("TEST BETA SDN. BHD.", ["Director"])]
    assert col(companies.ledger("documents", "alpha"), "SourcePath") == ["a.pdf"] and companies.ledger("documents").count() == 2
    assert companies.associations("nobody").count() == 0


FORM = """Division 8A, 60B (3), Companies Act 2016
Submission Number EB1
Date & Time Received 05/03/2024 10:11:12
COMPANY NAME TEST ALPHA SDN. BHD.
COMPANY NO 202001000001
STATUS EXISTING
PARTICULARS OF BENEFICIAL OWNERSHIP
STATUS NEW
DATE OF BECOMING BO 01/02/2024
TYPE INDIVIDUAL
CATEGORY OWNER
NAME ALICE
IDENTIFICATION NO. 800101011234
NATIONALITY MALAYSIA
Criteria A - Direct Ownership: 60.5
PARTICULARS OF BENEFICIAL OWNERSHIP
NAME NOBODY
PARTICULARS OF BENEFICIAL OWNERSHIP
STATUS CESSATION
DATE OF CESSATION 01/03/2024
NAME BOB
IDENTIFICATION NO. 700101011234
DECLARATION
NAME CAROL
DATE OF APPLICATION 04/03/2024
LODGER INFORMATION
NAME DAVE
IDENTIFICATION NO. 600101011234
"""


def test_forms_to_rows(spark):
    files = spark.createDataFrame([("x/EBOS 1.pdf", FORM), ("y.pdf", "other"), ("z.pdf", None)], "path string, text string")
    rows = owners.parse_forms(files).collect()
    assert [(r["Name"], r["IC"], r["BO Status"]) for r in rows] == [("ALICE", "800101011234", "NEW"), ("BOB", "700101011234", "CESSATION")]
    r = rows[0]
    assert (r["Source PDF"], r["Submission No"], r["Date Received"], r["Company No"], r["Criteria A - Direct Ownership %"]) == ("EBOS 1.pdf", "EB1", "05/03/2024", "202001000001", "60.5")
    assert (r["Declaration Name"], r["Lodger Name"], r["Lodger IC"], r["Nationality"]) == ("CAROL", "DAVE", "600101011234", "MALAYSIA")


@pytest.fixture(scope="module")
def events(spark):
    cols = "n int, `Company Name` string, `Company No` string, `Submission No` string, `BO Status` string, Name string, IC string, `Date Received` string, `Date of Becoming BO` string, `Date of Cessation` string, `Criteria A - Direct Ownership %` string"
    rows = [
        (1, "TEST ALPHA", "1", "S1", "NEW", "ALICE", "A", "01/01/2024", "01/01/2024", "", "50"),
        (2, "TEST ALPHA", "1", "S2", "CESSATION", "ALICE", "A", "01/02/2024", "", "01/02/2024", ""),
        (3, "TEST ALPHA", "1", "S3", "CESSATION", "BOB", "", "01/02/2024", "", "", "10"),
        (4, "TEST ALPHA", "1", "S3", "NEW", "BOB", "", "01/02/2024", "01/02/2024", "", "10"),
        (5, "TEST ALPHA", "1", "S4", "", "CAROL", "C", "01/01/2024", "01/01/2024", "05/01/2024", ""),
        (6, "TEST BETA", "2", "S5", "", "ALICE", "A", "", "", "", "30%"),
        (7, "TEST BETA", "2", "S5", "", "", "", "01/01/2024", "", "", ""),
        (8, "TEST BETA RENAMED", "2", "S6", "NEW", "DAVE", "D", "03/01/2024", "", "", ""),
    ]
    return spark.createDataFrame(rows, cols)


def test_current_owners(events):
    o = owners.Owners(events, "n")
    assert col(o.current(), "Company Name", "Name") == [("TEST ALPHA", "BOB"), ("TEST BETA", "ALICE"), ("TEST BETA RENAMED", "DAVE")]
    assert col(o.current("test alpha"), "Name") == ["BOB"]
    assert sorted(col(o.current("renamed"), "Name")) == ["ALICE", "DAVE"]  # by the number that both names have
    assert col(o.current("test"), "Name") == []
    assert col(o.current("test alpha"), "Direct Ownership %") == ["10"]
    assert col(o.history("alice"), "Submission No") == ["S2", "S1", "S5"]
    assert col(o.names("Name"), "Name") == ["ALICE", "BOB", "CAROL", "DAVE"]


def test_active_on(events):
    on = lambda d: sorted(col(owners.active_on(events, F.lit(d).cast("date")), "n"))
    assert on("2024-01-04") == [1, 5] and on("2024-01-05") == [1] and on("2023-12-31") == []


def test_consolidation_and_back(spark):
    rows = [("b.pdf", "A", "1", "E", "S1", "X", "01/01/2024"), ("a.pdf", "A", "1", "E", "S1", "X", "01/01/2024"), ("c.pdf", "A", "1", "E", "S2", "Y", "02/01/2024"), ("d.pdf", "A", "1", "E", "S0", "Z", "")]
    ev = spark.createDataFrame(rows, "`Source PDF` string, `Company Name` string, `Company No` string, `Company Status` string, `Submission No` string, Name string, `Date Received` string")
    once = owners.consolidate(ev)
    assert sorted(col(once, "slot", "Name", "Source PDF")) == [(1, "Y", "c.pdf"), (2, "X", "a.pdf"), (3, "Z", "d.pdf")]
    wide = owners.widen(once, ["Name", "Date Received"], 3)
    assert col(owners.to_long(wide), "slot", "Name", "Company Name") == [(1, "Y", "A"), (2, "X", "A"), (3, "Z", "A")]


def test_auditors(spark):
    rows = [(1, "TEST ALPHA", "1", "30 JUNE", "", "Y H Tan & Co", ""), (2, "TEST BETA", "2", "31 DECEMBER", "", "YH TAN AND CO", ""), (3, "TEST BETA", "2", "31 DECEMBER", "", "YH TAN AND CO", ""), (4, "TEST GAMMA", "", "30 JUNE", "", "YH Tan and Co X", ""), (5, "TEST DELTA", "4", "JUNE", "", "", "")]
    a = Auditors(spark.createDataFrame(rows, ", ".join(["n int", *[f"`{c}` string" for c in AUDITOR]])), "n")
    assert col(a.distinct(), "auditor", "companies") == [("YH TAN AND CO", 3)]
    assert col(a.by_auditor("y h tan"), "Company Name") == ["TEST ALPHA", "TEST BETA", "TEST GAMMA"]
    assert col(a.by_year_end("June"), "Company Name") == ["TEST ALPHA", "TEST DELTA", "TEST GAMMA"]
    assert col(a.by_year_end("30 June"), "Company Name") == ["TEST ALPHA", "TEST GAMMA"]
    assert col(a.of_company("beta"), "auditor") == ["YH TAN AND CO"] and a.companies().count() == 4
    with pytest.raises(ValueError):
        Auditors(a.df.drop("Reg No"), "n")


def test_register(spark):
    r = Register(spark.createDataFrame([("A & B", "1", "d", "m"), ("C", "2", "e", "n")], ", ".join(f"`{c}` string" for c in CONSTITUTION)), CONSTITUTION)
    assert col(r.information(["Reg No", "x"], "a and b"), "Company Name", "Reg No") == [("A & B", "1")]
    assert r.information(["Reg No"]).count() == 2


def text(section, **more):
    return f"{section}\n" + "\n".join(f"{k}: {v}" for k, v in more.items())


@pytest.mark.parametrize(("words", "want"), [("Section 51 register of members", "S51"), ("SECTION 78 return of  allotment", "S78"), ("section 58 director", "S58"), ("section 581 director", "OTHER"), ("AR1 annual return", "S68"), ("S E C T I O N 14 particulars of company", "S14"), ("form 24 shares", "S78"), ("FORM 49 secretary", "FORM49"), ("", "OTHER")])
def test_sections(spark, words, want):
    assert spark.createDataFrame([(words,)], "t string").select(filings.section(F.col("t"))).first()[0] == want


def test_filings(spark):
    s14 = "SECTION 14 SUPERFORM APPLICATION FOR REGISTRATION OF A COMPANY\nRegistration No: 202001000001 (123456-A)\nReference Number: R1\nSubmission Date: 01/02/2024"
    s58 = "SECTION 58 NOTIFICATION OF CHANGE IN THE REGISTER OF DIRECTORS\nRegistration No: 123456-A\nReference Number: R2\nROA05032024\nDIRECTORS\nADD DIRECTOR\nName ALICE\nIdentification No. 800101011234\nDate of Appointment 01/03/2024\nCEASE DIRECTOR\nName BOB\nDate of Cessation 02/03/2024\nType of Cessation RESIGNED\nLODGER INFORMATION\nName X"
    other = "SECTION 78 RETURN OF ALLOTMENT\nRegistration No: 202001000009\nReference Number: R3"
    files = [("F", "s14.pdf", s14, "h1"), ("F", "s14 approved.pdf", s14, "h1"), ("F", "copy.pdf", s14, "h2"), ("F", "s58.pdf", s58, "h3"), ("F", "s78 2024-05-06.pdf", other, "h4"), ("F", "receipt s58.pdf", s58, "h5"), ("F", "empty.pdf", " ", "h6"), ("F", "letter.pdf", "dear", "h7")]
    rec = filings.read(spark.createDataFrame(files, "folder string, path string, text string, sha256 string"))
    got = {r.path: r for r in filings.canonicalise(rec).collect()}
    assert {p: r.status for p, r in got.items()} == {"s14.pdf": "DUPLICATE", "s14 approved.pdf": "VALID", "copy.pdf": "DUPLICATE", "s58.pdf": "VALID", "s78 2024-05-06.pdf": "REG_MISMATCH", "receipt s58.pdf": "EXCLUDED", "empty.pdf": "UNREADABLE", "letter.pdf": "OTHER"}
    assert (got["s58.pdf"].lodged, got["s58.pdf"].lodged_from) == (dt.date(2024, 3, 5), "REFERENCE")
    assert got["s78 2024-05-06.pdf"].lodged_from == "FILENAME" and got["s14.pdf"].lodged == dt.date(2024, 2, 1)
    ev = filings.officer_events(rec.where("path = 's58.pdf'")).orderBy("event").collect()
    assert [(r.event, r.Name, r.IC, r.event_date) for r in ev] == [("APPOINT", "ALICE", "800101011234", dt.date(2024, 3, 1)), ("CEASE", "BOB", "", dt.date(2024, 3, 2))]
    assert sorted(r.code for r in filings.issues(filings.canonicalise(rec)).collect()) == ["REGISTRATION_MISMATCH", "UNREADABLE_FILING"]


def test_contexts(spark):
    c = spark.createDataFrame([("A & B", "1"), ("C", ""), ("D", "4")], "`Company Name` string, `Reg No` string")
    fs = spark.createDataFrame([("A AND B", 5), ("D", 6), ("D", 7)], "Company string, fee int")
    au = spark.createDataFrame([("A & B", "1", "x"), ("C", "3", "y"), ("D", "4", "z")], "`Company Name` string, `Reg No` string, a string")
    got = {r["Company Name"]: r for r in contexts.company_contexts(c, {"fs": (fs, "Company"), "auditor": (au, "Company Name")}).collect()}
    assert got["A & B"].issues == [] and got["A & B"].fs.fee == 5 and got["A & B"].auditor.a == "x"
    assert got["C"].issues == ["missing_registration_no", "fs_not_found", "auditor_registration_mismatch"]
    assert got["D"].issues == ["fs_ambiguous"] and got["D"].fs is None


def test_fees_and_dates(spark):
    m = spark.createDataFrame([("k", "ALICE", 1), ("k", "BOB", 1), ("k", "CAROL", 1), ("k", "DAVE", 1)], "k string, name string, shares int")
    d = spark.createDataFrame([("k", "Alice"), ("k", "Bob"), ("k", "Carol")], "k string, name string")
    assert sorted(col(contexts.fees(F.lit(100.0), m, d, "k", "name", "shares"), "name", "cents")) == [("ALICE", 3333), ("BOB", 3333), ("CAROL", 3334)]
    x = spark.sql("select date'2024-01-01' a, date'2023-12-31' b, cast(null as date) c")
    assert x.select(contexts.date_order({"start": F.col("a"), "end": F.col("b"), "board": F.col("c")})).first()[0] == ["missing_board", "start_after_end"]
    y = spark.sql("select '' a, 'v' b").select(contexts.first_source({"x": F.col("a"), "y": F.col("b")}).alias("f"), contexts.provenance(F.col("a"), "s", candidates=F.array(F.lit("q"))).alias("p")).first()
    assert (y.f.source, y.p.status, y.p.value) == ("y", "suggested", None)
    t = spark.createDataFrame([(20, 100, ""), (19, 100, ""), (0, 100, "Yes")], "s int, t int, c string")
    assert [r[0] for r in t.select(contexts.owner_test(F.col("s"), F.col("t"), F.col("c"))).collect()] == [True, False, True]
    a, b = spark.createDataFrame([("k", "", "x"), ("m", None, "y")], "k string, u string, v string"), spark.createDataFrame([("k", "filled", "no"), ("m", "1", "2"), ("m", "1", "2")], "k string, u string, v string")
    assert sorted(col(contexts.enriched(a, b, "k", ["u", "v"]), "k", "u", "v"), key=str) == [("k", "filled", "x"), ("m", None, "y")]


def test_people_of_a_frequent_key_meet_events_in_several_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from karst.records import candidates as C

    monkeypatch.setattr(C, "PAIRS", 10)
    people = spark.createDataFrame([(k, "I1" if k % 2 else "", "N1") for k in range(40)] + [(40, "I2", "N2"), (40, "I2", "N2")], "k long, identity string, name string")
    events = spark.createDataFrame([(e, "I1", "N1") for e in range(5)] + [(5, "", "N1"), (6, None, "N2"), (6, None, "N2"), (7, "I3", "N3")], "e long, identity string, name string")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        rows = C.person_events(people, events, "k", "identity", "name").select("person", "e", F.spark_partition_id().alias("t")).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted((r.person, r.e) for r in rows) == sorted([(k, e) for k in range(40) for e in range(6)] + [(40, 6)] * 4)
    assert len({r.t for r in rows if r.e == 0 and r.person % 2}) > 1  # one key


def test_a_text_is_searched_once_for_each_pattern(spark):
    """Section and date of a filing are asked for several times, and worked out once."""
    files = spark.createDataFrame([("A", "p", "x", "h")], "folder string, path string, text string, sha256 string")
    plan = filings.read(files)._jdf.queryExecution().optimizedPlan().toString()
    told = [plan.count(x) for x in ("(?:Submission|Submitted)", "(?:ROM|CPO", "REGISTER\\s+OF\\s+MEMBERS", "ANNUAL RETURN", "PARTICULARSOFCOMPANY")]
    assert told == [1] * 5, told
