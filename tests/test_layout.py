from pyspark.sql import functions as F

from karst.records import layout

def put(*cells):
    """A line with texts at places."""
    out = ""
    for at, text in cells:
        out = out.ljust(at) + text
    return out


HEAD = [
    "SECTION E: PARTICULARS OF MEMBERS", put((13, "Type of")),
    put((6, "Reference"), (24, "Title/Name"), (36, "Type/"), (50, "Passport"), (56, "Nationality/"), (69, "Gender"), (77, "Date of birth"), (92, "Address"), (102, "Number of"), (113, "Analysis")),
]


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def member(no, *, at=(6, 13, 24, 36, 56, 69, 77, 92, 102, 113), name="ALICE", number="800101010001", paper="MYKAD", country="MALAYSIA", shares="100", kind="ORDINARY", address=("1, RD A/", "TN 10000")):
    first = put((0, no), (at[0], "0001"), (at[1], "INDIVIDUAL"), (at[2], name), (at[3], paper), (at[4], country), (at[5], "FEMALE"), (at[6], "01/01/1980"), (at[7], address[0]), (at[8], shares), (at[9], "CITIZENS"))
    return [first, put((at[2], "BE"), (at[3], number), (at[4], "CHINESE"), (at[7], address[1]), (at[8], kind), (at[9], "WHO ARE"))]


def test_a_member_whose_values_left_the_headings(spark):
    moved = (7, 17, 29, 35, 60, 75, 84, 99, 113, 126)
    text = "\n".join([*HEAD, *member("0001", at=moved), *member("0002", name="CAROL", number="800101010002", kind="PREFERENCE", shares="1 0 0"), "TOTAL NUMBER OF SHARES 200", *member("0003")])
    got = layout.members(files(spark, a=text, b=None, c="", d="SECTION E : PARTICULARS OF MEMBERS\n" + "\n".join(member("0001")))).orderBy("pos").collect()
    assert [(r.path, r.Name, r["ID No"], r["ID Type"], r.Nationality, r.Race, r.Gender, r.DOB, r.Shares, r["Share Type"], r.Analysis, r.Type) for r in got] == [
        ("a", "ALICE BE", "800101010001", "MYKAD", "MALAYSIA", "CHINESE", "FEMALE", "01/01/1980", "100", "ORDINARY SHARES", "CITIZENS WHO ARE", "INDIVIDUAL"),
        ("a", "CAROL BE", "800101010002", "MYKAD", "MALAYSIA", "CHINESE", "FEMALE", "01/01/1980", "100", "PREFERENCE SHARES", "CITIZENS WHO ARE", "INDIVIDUAL"),
    ]
    assert {r.Address for r in got} == {"1, RD A/ TN 10000"}


def test_digits_that_left_their_cells_and_people_of_one_address(spark):
    text = "\n".join([*HEAD, *member("0001", name="ALICE", number="00101010001"), *member("0002", kind="ORDINARY 7"), *member("0003", name="BOB", number="A1234567", paper="PASSPORT", country="CHINA")])
    text = text.replace(" BE          00101010001", " BE 8        00101010001")
    one, two, three = layout.members(files(spark, a=text)).orderBy("pos").collect()
    assert (one.Name, one["ID No"]) == ("ALICE BE", "800101010001")
    assert two.Address == "1, RD A/7 TN 10000" and two["Share Type"] == "ORDINARY SHARES"
    assert (three["ID Type"], three["ID No"], three.Nationality, three.Race) == ("PASSPORT", "A1234567", "CHINA", "CHINESE")
    mended = layout.registers(files(spark, a=text))[1].orderBy("pos").collect()[2]
    assert (mended.Name, mended["ID No"]) == ("ALICE BE", "800101010001")


def director(no, scale=1.0, service="2 ROAD", mail="a@example.com"):
    at = [round(x * scale) for x in (6, 18, 31, 39, 47, 59, 67, 82, 99, 116)]
    first = put((0, no), (at[0], "DAVE"), (at[1], "DIRECTOR"), (at[2], "MYKAD"), (at[4], "MALAYSIA"), (at[5], "MALE"), (at[6], "1970-02-03"), (at[7], "1 STREET"), (at[8], service), (at[9], "TRADER"))
    return [first], [put((at[0], "N" + no), (at[2], "7002030"), (at[4], "INDIAN"), (at[7], "TOWN"), (at[8], mail)), put((at[2], "10001"))]


def test_directors_over_pages_of_other_widths(spark):
    head = ["Particulars of Directors", put((31, "Type"), (39, "Passport"), (47, "Nationality/")), put((6, "Title/Name"), (18, "Designation"), (59, "Gender"), (67, "Date of birth"), (82, "Residential"), (99, "Service"), (116, "Business"))]
    one, two, three = director("0001"), director("0002"), director("0003", 2.0)
    over = director("0002", 2.0)
    page1 = [*head, *one[0], *one[1], *two[0], "Page 1 of 2"]
    page2 = ["Company No: 5", "", *over[1], *three[0], *three[1], "Particulars of Managers", *director("0004", 2.0)[0]]
    got = layout.directors(files(spark, a="\n".join(page1) + "\f" + "\n".join(page2))).orderBy("pos").collect()
    assert [(r.Name, r.IC, r["ID Type"], r.Nationality, r.Race, r.DOB, r.Residential, r["Service Address"], r.Email, r["Business Occupation"]) for r in got] == [
        (f"DAVE N{n}", "700203010001", "MYKAD", "MALAYSIA", "INDIAN", "1970-02-03", "1 STREET TOWN", "2 ROAD", "a@example.com", "TRADER") for n in ("0001", "0002", "0003")
    ]
    lacking = "\n".join(page1).replace("Gender", "Sex   ")
    assert layout.directors(files(spark, a=lacking)).count() == 0


def test_headings_identities_and_nationalities(spark):
    df = spark.createDataFrame([(["  Type x Type", "Type/"], "passport number A-1 23", "VIET NAM (X) FOREIGNER kinh", "MALAYSIAN MALAY"), (["none"], "123-4", "CHINA", "")], "l array<string>, i string, n string, m string")
    r = df.select(layout.heading_at(F.col("l"), "Type").alias("a"), layout.heading_at(F.col("l"), "Type", F.lit(3)).alias("b"), layout.identity(F.col("i")).alias("i"), layout.nationality(F.col("n")).alias("n"), layout.nationality(F.col("m")).alias("m")).collect()
    assert (r[0].a, r[0].b, r[1].a) == (0, 9, None)
    assert tuple(r[0].i) == ("PASSPORT", "A123") and tuple(r[1].i) == ("", "1234")
    assert tuple(r[0].n) == ("VIET NAM (X)", "kinh") and tuple(r[0].m) == ("MALAYSIA", "MALAY") and tuple(r[1].n) == ("CHINA", "") and tuple(r[1].m) == ("", "")
