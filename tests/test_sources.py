import sqlite3

import pytest

from karst.sources import sqlite, tables, workbook


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "T t" (Folder TEXT, "Reg No" TEXT, n INTEGER, x REAL)')
        c.executemany('INSERT INTO "T t" VALUES (?, ?, ?, ?)', [(f"F{i % 3}", None if i == 2 else str(i), i, i / 2) for i in range(10)])
    df = sqlite.scan(spark, path, "T t", 3)
    assert df.dtypes == [("Folder", "string"), ("Reg No", "string"), ("n", "bigint"), ("x", "double"), ("_rowid", "bigint")]
    assert df.rdd.getNumPartitions() == 3 and sorted(r.n for r in df.collect()) == list(range(10))
    assert sorted(r.n for r in df.where("Folder = 'F1'").collect()) == [1, 4, 7]
    assert df.where("n = 2").first()["Reg No"] is None
    with pytest.raises(Exception, match="no table"):
        sqlite.scan(spark, path, "nope")
    with pytest.raises(ValueError):
        sqlite.scan(spark, path, "T t", allowed=("U",))


def test_sqlite_sink(spark, tmp_path):
    path = str(tmp_path / "b.db")
    df = spark.createDataFrame([("a", 1, 1.5), ("b", None, None)], "k string, n long, x double")
    assert sqlite.write(df, path, "T", key="k") == 2
    assert sqlite.write(df.limit(1), path, "T", key="k") == 1 and sqlite.tables(path) == ["T"]
    with pytest.raises(sqlite3.IntegrityError):
        sqlite.write(df.union(df), path, "T", key="k")
    with sqlite.connect(path) as c:
        assert c.execute("SELECT * FROM T").fetchall() == [("a", 1, 1.5)]


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "c.xlsx")
    df = spark.createDataFrame([("TEST <A> & B", 12, 1.5, None), (" ", None, None, "800101011234"), (None, None, None, None)], "`Company Name` string, n long, x double, `ID No` string")
    assert workbook.write(df, path, "S & T") == 3
    rows = workbook.read_rows(spark, f"file://{path}")
    t = workbook.as_table(rows, "S & T", ["Company Name", "n", "x", "ID No"])
    assert sorted((tuple(r) for r in t.collect()), key=str) == [(2, "TEST <A> & B", "12", "1.5", None), (3, None, None, None, "800101011234")]
    with pytest.raises(ValueError):
        workbook.as_table(rows, "S & T", ["x"])
    with pytest.raises(ValueError):
        workbook.as_table(rows, "none")


def test_vertical_sheets(spark):
    rows = spark.createDataFrame([("p", "A", 1, ["Folder", "F1", None]), ("p", "A", 2, ["Reg No", "1", "old"]), ("p", "B", 1, ["Folder", "F2"])], workbook.ROWS)
    got = {r.sheet: (r["Folder"], r["Reg No"]) for r in workbook.as_records(rows, ["Folder", "Reg No"]).collect()}
    assert got == {"A": ("F1", "1 | old"), "B": ("F2", None)}


def test_dates_in_cells():
    assert workbook._when(45352.0) == "2024-03-01" and workbook._when(45352.5) == "2024-03-01 12:00:00"
    assert [workbook._column(workbook._name(i) + "7") for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_workbooks_of_one_sheet_name_stay_apart(spark, tmp_path):
    for i in (1, 2):
        workbook.write(spark.createDataFrame([(f"a{i}", i)], "k string, n long"), f"{tmp_path}/{i}.xlsx", "S")
    rows = workbook.read_rows(spark, str(tmp_path))
    assert sorted(map(tuple, workbook.as_table(rows, "S").select("k", "n").collect())) == [("a1", "1"), ("a2", "2")]
    assert workbook.as_records(rows, ["a1", "a2"], 2).count() == 2
    workbook.write(spark.createDataFrame([("x",)], "other string"), f"{tmp_path}/3.xlsx", "S")
    with pytest.raises(ValueError, match="different headings"):
        workbook.as_table(workbook.read_rows(spark, str(tmp_path)), "S")


def test_upsert_by_number_or_folder(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([("R1", "F1", 1), ("R2", "F2", 2), ("", "F3", 3), ("R4", "", 4)], "reg string, folder string, n int").write.parquet(path)
    new = spark.createDataFrame([("R1", "F9", 10, "x"), ("", "F3", 30, "y"), ("R5", "", 50, "z")], "reg string, folder string, n int, more string")
    tables.upsert_table(spark, path, new, "reg", "folder")
    got = sorted(map(tuple, spark.read.parquet(path).select("reg", "folder", "n", "more").collect()))
    assert got == [("", "F3", 30, "y"), ("R1", "F9", 10, "x"), ("R2", "F2", 2, None), ("R4", "", 4, None), ("R5", "", 50, "z")]
    with pytest.raises(ValueError, match="not unique"):
        tables.upsert_table(spark, path, new.union(new), "reg", "folder")


def test_ordinal_is_the_place_in_the_file(spark, tmp_path):
    spark.range(0, 1000, 1, 1).write.parquet(f"{tmp_path}/t")
    rows = tables.read_table(spark, f"{tmp_path}/t", ordinal="o").repartition(7).selectExpr("id", "o.row_index as at").collect()
    assert all(r.id == r.at for r in rows) and len(rows) == 1000


def test_same_rows_value_by_value(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert tables.same_rows(a, a.repartition(3), fully=True) and not tables.same_rows(a, a.distinct(), fully=True)


def test_slots_stand_together():
    from karst.operators.reshape import slots_together

    assert slots_together(["a", "D2 x", "b", "D1 x", "D10 x", "D1 y"], "D") == ["a", "D1 x", "D1 y", "D2 x", "D10 x", "b"]
    assert slots_together(["a"], "D") == ["a"]
