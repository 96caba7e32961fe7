import datetime

import pytest
from pyspark.sql import functions as F

from karst.records import papers
from karst.records.registers import Auditors
from karst.sources.discovery import INDEX, rotation_workbooks, whole_list


def test_lists_must_be_whole(spark):
    make = lambda rows: spark.createDataFrame(rows, "Sequence int, Worksheet string, Folder string, `Company Name` string, `Reg No` string")
    good = [(1, " a ", "x", "y", None), (None, " ", "", None, None), (2, "b", "x", "y", "z")]
    assert [tuple(r) for r in whole_list(make(good), INDEX, "Worksheet", 2).orderBy("Sequence").collect()] == [("1", "a", "x", "y", ""), ("2", "b", "x", "y", "z")]
    for rows, n, said in ((good, 3, "to be listed"), ([*good, (3, "b", "", "", "")], 3, "unique"), ([*good, (3, "", "q", "", "")], 3, "blank")):
        with pytest.raises(ValueError, match=said):
            whole_list(make(rows), INDEX, "Worksheet", n)
    with pytest.raises(ValueError, match="missing"):
        whole_list(make(good).drop("Folder"), INDEX, "Worksheet", 2)


def test_workbooks_of_retirements(spark):
    asked = spark.createDataFrame([("A", 2024), ("A", 2023), ("B", 2024), (None, 2024)], "folder string, year int")
    files = spark.createDataFrame([(p,) for p in ("A/AGM/2024/x Retirement.XLSX", "A/AGM/Rotation.xlsm", "A/rotation.xlsx", "B/AGM/2024/sub/rotation.xlsx", "B/AGM/rotation.docx")], "path string")
    got = {(r.folder, r.year): (r.path, r.issue) for r in rotation_workbooks(asked, files, "folder", "year").collect()}
    assert got == {("A", 2024): ("A/AGM/2024/x Retirement.XLSX", None), ("A", 2023): ("A/AGM/Rotation.xlsm", None), ("B", 2024): (None, "rotation_workbook_missing"), (None, 2024): (None, "rotation_workbook_missing")}


def test_papers_of_a_folder(spark):
    rows = [
        ("F", "a/sec51 x.pdf", "Submission Date: 01/02/2020", 5), ("F", "a/Section 51 y.pdf", "Submission Date: 01/02/2021", 5), ("F", "a/Section 51 z.pdf", None, 5), ("F", "section 51/other.pdf", "Submission Date: 01/02/2022", 5),
        ("F", "a/section 58.pdf", "secretary Submission Date: 01/02/2022", 5), ("F", "a/r.pdf", "AR1 Date of annual return 2022-01-01", 5), ("F", "a/r2.pdf", "AR1 Submission Date 03/04/2021", 5), ("G", "section 14.pdf", "Incorporation Date: 05/05/2015", 9), ("G", "old section 14.pdf", "Incorporation Date: 06/06/2016", 1), ("G", "section 17.pdf", "nothing", 1),
    ]
    files = spark.createDataFrame(rows, "folder string, path string, text string, size int")
    assert [(r.path, str(r.date)) for r in papers.latest(files, "S51").collect()] == [("a/Section 51 y.pdf", "2021-02-01")]
    assert papers.latest(files, "S58").count() == 0 and papers.listed(files.limit(0), "S58").count() == 0
    assert [(r.path, str(r.date)) for r in papers.latest(files, "S68").collect()] == [("a/r2.pdf", "2021-04-03")]
    assert [(r.folder, str(r.date)) for r in papers.incorporated(files).collect()] == [("G", "2015-05-05")]
    day = lambda n: F.lit(None if n is None else datetime.date(2020, 1, n)).cast("date")
    got = spark.range(1).select(*[papers.replaces(day(a), day(b), F.lit(m)) for a, b, m in ((2, 1, 1), (1, 1, 1), (2, 1, 0), (1, None, 1), (None, None, 1), (None, 1, 1))]).first()
    assert list(got) == [True, False, False, True, False, False]


def test_an_auditors_name_as_it_is_shown(spark):
    rows = [("C1", "1", "30 JUNE", "A.B. Tan & Co", 1), ("C2", "2", "30 JUNE", "A B TAN AND CO", 2), ("C3", "3", "30 JUNE", "A.B. Tan & Co", 3), ("C4", "4", "30 JUNE", "Other PLT", 4)]
    df = spark.createDataFrame(rows, "`Company Name` string, `Reg No` string, `Financial Year End` string, `Auditor Name` string, o int")
    for c in ("Auditor Firm No", "Auditor Address", "UpdatedAt"):
        df = df.withColumn(c, F.lit(""))
    a = Auditors(df, "o")
    name = lambda x: [r.auditor for r in a.display_name(x).collect()]
    assert name("ab tan & co") == ["A.B. Tan & Co"] == name("TAN AND CO") and name("PLT") == ["Other PLT"] and name("nobody") == [] == name("")
