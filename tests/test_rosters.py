import pytest

from karst.records import rosters


def files(spark, text):
    return spark.createDataFrame([("p", text), ("null", None), ("empty", "")], "path string, text string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize(("info", "want"), [
    ("TEST BETA SDN. BHD. 2 STREET TOWN", ("TEST BETA SDN. BHD.", "2 STREET TOWN")), ("TEST BETA SDN BHD", ("TEST BETA SDN BHD", "")), ("TEST LIMITED NO. 5 JALAN A", ("TEST LIMITED", "NO. 5 JALAN A")), ("ALICE TAN LOT 7 X 50000 TOWN", ("ALICE TAN", "LOT 7 X 50000 TOWN")),
    ("ALICE TAN 50000 TOWN", ("ALICE TAN", "50000 TOWN")), ("ALICE TAN SINGAPORE", ("ALICE TAN", "SINGAPORE")), ("NO JALAN ALICE", ("NO JALAN ALICE", "")), ("ALICE", ("ALICE", "")), ("ABC INC. JALAN X MALAYSIA", ("ABC INC.", "JALAN X MALAYSIA")),
])
def test_where_a_name_ends(spark, info, want):
    text = f"PARTICULAR OF SHAREHOLDERS\nNAME ADDRESS\n800000000001\n{info}\nPADDING-LINE-{'x' * 9}\n1 2 3 4\nDECLARATION".replace(f"\nPADDING-LINE-{'x' * 9}", "")
    got = rows(rosters.members_s51(files(spark, text)), "IC", "Name", "Address", "Shares")
    assert got == ([("800000000001", *want, 4)] if len(f"NAME ADDRESS 800000000001 {info}") >= 20 else [])


def test_lines_of_a_register(spark):
    text = "x PARTICULAR OF SHAREHOLDERS\nNUMBER OF SHARES\nA12­\n345 BOB LEE\nJALAN B 10000 TOWN MALAYSIA 1,000 0 0 1,000 05/06/2020\nshort\n1 2 3 4\nTOTAL SHARES 9 9 9\nC77777 FIRM PLC\n1 ROAD, TOWN\n5 6 7 8\nANALYSIS OF SHAREHOLDINGS\n800000000009 NOBODY JALAN 1\n1 1 1 1"
    got = rows(rosters.members_s51(files(spark, text)), "IC", "Name", "Address", "Shares", "Date", "Nationality", "Type")
    assert got == [("A12345", "BOB LEE", "JALAN B 10000 TOWN MALAYSIA", 1000, "05/06/2020", "MALAYSIA", "INDIVIDUAL"), ("C77777", "FIRM PLC", "1 ROAD, TOWN", 8, "", "", "COMPANY")]


def test_directors_by_words(spark):
    row = "0001 ALICE  TAN DIRECTOR OF TRADE MYKAD 800000000001 MALAYSIA CHINESE FEMALE 1980-01-02 1 ROAD MALAYSIA {} 0002 NO ANCHOR DIRECTOR 5 MALAYSIA X MALE soon"
    want = ("ALICE TAN", "800000000001", "CHINESE", "FEMALE", "1980-01-02", "1 ROAD MALAYSIA")
    for tail, work in (("2 ROAD MALAYSIA DIRECTOR", "2 ROAD MALAYSIA"), ("a.b @x.example MANAGER c@y.example", "a.b@x.example"), ("", "")):
        text = f"Particulars of Directors {row.format(tail)} Particulars of Managers"
        assert rows(rosters.directors_s68(files(spark, text)), "Name", "IC", "Race", "Gender", "DOB", "Residential", "Service Address") == [(*want, work)]
    abroad = "Particulars of Directors 0001 BOB DIRECTOR 77 MALAYSIA INDIAN MALE 1980-01-02 1 ROAD INDIA rest Particulars of Managers"
    assert rows(rosters.directors_s68(files(spark, abroad)), "Name", "IC", "Residential", "Service Address") == [("BOB", "77", "1 ROAD INDIA", "")]


def test_members_by_words(spark):
    head = "SECTION E: PARTICULARS\n"
    full = "0001 0001 BODY CORPORATE FIRM A PASSPORT E-12 SINGAPORE OTHER MALE 02/01/1980 1 ROAD 5 0 0 0 0 TOWN MALAYSIA 1,0 00 ORDINARY SHARES NON-CITIZENS"
    bare = "0002 0001 ALICE CHINESE FEMALE 02/01/1980 1 ROAD OF SOME LENGTH MALAYSIA 10 SHARES"
    got = rows(rosters.members_s68(files(spark, f"{head}{full}\n{bare}\n0003 0001 no date of birth here at all, sorry\nTOTAL NUMBER OF SHARES 5\nSECTION F")), "Type", "Name", "ID Type", "ID No", "Nationality", "Race", "Gender", "DOB", "Address", "Shares", "Share Type", "Analysis")
    assert got == [
        ("BODY CORPORATE", "FIRM A", "PASSPORT", "E-12", "SINGAPORE", "OTHER", "MALE", "02/01/1980", "1 ROAD 50000 TOWN MALAYSIA", 1000, "ORDINARY SHARES", "NON-CITIZENS"),
        ("", "", "", "", "ALICE", "CHINESE", "FEMALE", "02/01/1980", "1 ROAD OF SOME LENGTH MALAYSIA", None, "", ""),
    ]


def test_rows_are_read_once(spark):
    """What a row's words tell is not worked out again by each filter and lambda that needs it."""
    files = spark.createDataFrame([("p", "x")], "path string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(rosters.directors_s68(files)).count(rosters.ISO_DAY) <= 3  # the table's rows, those that the join leaves out, the others
    assert plan(rosters.members_s51(files)).count(r"PARTICULAR\s+OF\s+SHAREHOLDERS") == 1
