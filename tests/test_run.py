import pytest
from pyspark.sql import functions as F

from karst.records import run

FORM = """APPLICATION FOR REGISTRATION OF A COMPANY
Proposed name: TEST COMPANY
Registration No.: 202001000001
Business Address: 8 ROAD
Office No: 1
Incorporation Date: 01/02/2020
Total number of shares: 100
PARTICULARS OF DIRECTOR
Director Name: ALICE
Identification No.: 800000000001
PARTICULARS OF MEMBER
Member Name: ALICE
ID Type: MYKAD
Identification No.: 800000000001
Number of share: 100
Class of share: ORDINARY
DECLARATION"""
ALLOTMENT = """SECTION 78 RETURN OF ALLOTMENT
Date of Allotment: 05/03/2021
PARTICULAR OF ALLOTTEES
1 BOB 800000000002 1 STREET CASH 50
DECLARATION"""
NOTICE = """SECTION 58 NOTIFICATION OF CHANGE OF DIRECTOR
DIRECTORS
ADD DIRECTOR
Name BOB
Identification No. 800000000002
Date of Appointment 05/03/2021
CEASE DIRECTOR
Name ALICE
Identification No. 800000000001
Date of Cessation 06/03/2021
LODGER INFORMATION"""
FILES = [
    ("A", "a/form", FORM, "h1"), ("A", "a/copy of form", FORM, "h1"), ("A", "a/allotment", ALLOTMENT, "h2"), ("A", "a/notice", NOTICE, "h3"), ("A", "a/blank", " ", "h4"), ("A", "a/null", None, "h5"),
    ("A", "a/draft resolution", FORM, "h6"), ("A", "a/letter", "Dear all", "h7"), ("B", "b/allotment", ALLOTMENT, "h8"), ("A", "a/other", FORM.replace("202001000001", "202001000000").replace("01/02/2020", "01/02/2019"), "h9"),
]


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    files = spark.createDataFrame(FILES, "folder string, path string, text string, sha256 string").withColumn("size", F.length("text"))
    return run.full_run(files, f"file://{tmp_path_factory.mktemp('run')}/r")


def test_companies(done):
    (row,) = done.companies.collect()
    assert (row.folder, row.company_name, str(row.incorporate_date), str(row.section58_date), row.total_shares, row.business_address) == ("A", "TEST COMPANY", "2020-02-01", "None", 150, "8 ROAD")
    assert [(m.slot, m.name, m.shares) for m in row.members] == [(1, "ALICE", 100), (2, "BOB", 50)] and [(x.slot, x.name, x.appointment_date) for x in row.directors] == [(1, "BOB", "2021-03-05")]
    flat = run.wide(done.companies, 3, 2).first()
    assert (flat["Member2 name"], flat["Member2 shares"], flat["Member3 name"], flat["Director1 ic"], flat["Director2 name"]) == ("BOB", "50", "", "800000000002", "")


def test_documents_events_and_issues(done):
    assert {r.path: (r.section, r.status) for r in done.documents.collect()} == {
        "a/form": ("S14", "VALID"), "a/copy of form": ("S14", "DUPLICATE"), "a/allotment": ("S78", "VALID"), "a/notice": ("S58", "VALID"), "a/blank": ("OTHER", "UNREADABLE"), "a/null": ("OTHER", "UNREADABLE"),
        "a/draft resolution": ("S14", "EXCLUDED"), "a/letter": ("OTHER", "OTHER"), "b/allotment": ("S78", "VALID"), "a/other": ("S14", "REG_MISMATCH"),
    }
    assert sorted((r.folder, r.event_type, r.subject_key, str(r.effective)) for r in done.events.collect()) == [
        ("A", "ALLOTMENT", "ID:800000000002", "2021-03-05"), ("A", "APPOINT", "ID:800000000002", "2021-03-05"), ("A", "CEASE", "ID:800000000001", "2021-03-06"), ("A", "DIRECTOR_SNAPSHOT", "ID:800000000001", "2020-02-01"), ("A", "MEMBER_SNAPSHOT", "ID:800000000001", "2020-02-01"), ("B", "ALLOTMENT", "ID:800000000002", "2021-03-05"),
    ]
    assert sorted((r.folder, r.code, r.source_path) for r in done.issues.collect()) == [("A", "REGISTRATION_MISMATCH", "a/other"), ("A", "UNREADABLE_FILING", "a/blank"), ("A", "UNREADABLE_FILING", "a/null"), ("B", "NO_PROFILE_SNAPSHOT", "")]


def test_texts_are_read_once(spark, tmp_path):
    """Only the first pass scans the files; what comes after reads a section's papers or no texts at all."""
    spark.createDataFrame(FILES, "folder string, path string, text string, sha256 string").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    out = run.full_run(files, f"file://{tmp_path}/r")
    for df in out:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert f"{tmp_path}/files" not in plan and df._jdf.inputFiles() is not None
        assert not any(f.startswith(f"file://{tmp_path}/files") or "/papers/" in f for f in df.inputFiles())
