"""Drafts, rotation sheets, folders and older notifications."""

import datetime as dt
import re

import pytest

from karst.records import drafts, updates


def test_retiring_directors(spark):
    sheet = spark.createDataFrame([("a", 1, ["No", "Name", "2023", "2024"]), ("a", 2, ["1", "ALICE", "x", ""]), ("a", 3, ["2", "Bob.", None, "X"]), ("a", 4, ["3", "EVE", "", "yes"]), ("a", 5, ["4", "DAN", "", "no"]), ("b", 1, ["Name", "2024", "FY 2024"]), ("c", 1, ["Name", "2020"])], "path string, row int, cells array<string>")
    people = spark.createDataFrame([("ALICE",), ("BOB",)], "Name string")
    got = {tuple(r) for r in drafts.retiring(sheet, 2024, people).collect()}
    assert got == {("a", "Bob.", "BOB", None), ("a", "EVE", None, "DIRECTOR_NOT_FOUND"), ("b", None, None, "YEAR_AMBIGUOUS"), ("c", None, None, "YEAR_NOT_FOUND")}


def test_a_row_numbered_like_the_year_is_no_heading(spark):
    sheet = spark.createDataFrame([("a", 1, ["No", "Name", "2023"]), ("a", 2, ["2024", "Person No 2024", "yes"]), ("b", 1, ["No", "Name", "2024"]), ("b", 2, ["2024", "Person No 2024", "yes"])], "path string, row int, cells array<string>")
    people = spark.createDataFrame([("PERSON NO 2024",)], "Name string")
    assert {tuple(r) for r in drafts.retiring(sheet, 2024, people).collect()} == {("a", None, None, "YEAR_NOT_FOUND"), ("b", "Person No 2024", "PERSON NO 2024", None)}


def _sheets(spark):
    lines = [("a", 1, ["No", "Name", "2024"]), ("a", 2, ["1", " Al Bo ", " x "]), ("a", 3, ["2", None, "yes"]), ("a", 4, ["3", "EVE", "-"]), ("b", 1, [None, "", "x"]), ("b", 2, ["Name", "2023", "", "FY 2024"]), ("b", 3, ["AL-BO", "", "x", "1"]), ("b", 4, ["TWIN", "", "x"]), ("b", 5, ["Twin", "", None, "Y"]), ("c", 1, ["x", "AL BO"])]
    people = spark.createDataFrame([("AL BO",), ("TWIN",), ("Twin.",), (None,), ("",)], "Name string")
    return spark.createDataFrame(lines, "path string, row int, cells array<string>"), people


_RETIRING = {("a", "Al Bo", "AL BO", None), ("a", "yes", None, "DIRECTOR_NOT_FOUND"), ("b", "AL-BO", "AL BO", None), ("b", "Twin", None, "DIRECTOR_AMBIGUOUS"), ("c", None, None, "YEAR_NOT_FOUND")}


@pytest.mark.parametrize(("places", "few"), [(16, 100_000), (0, 100_000), (16, 0)])
def test_retiring_by_places_and_size(spark, monkeypatch, places, few):
    from karst.operators import lookup

    sheet, people = _sheets(spark)
    monkeypatch.setattr(drafts, "PLACES", places)
    monkeypatch.setattr(drafts, "small", lambda df: lookup.small(df, few))
    assert sorted(map(tuple, drafts.retiring(sheet, 2024, people).collect()), key=repr) == sorted(_RETIRING, key=repr)


def test_rows_matched_before_they_are_on_sheets_and_a_listed_sheet_without_rows(spark):
    sheet, people = _sheets(spark)
    rows = drafts.matched(sheet, people)
    assert rows.count() == sheet.count() and rows.where("name is null and issue is not null").isEmpty()
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "path string")
    got = sorted(map(tuple, drafts.retiring(rows, 2024, sheets=listed).collect()), key=repr)
    assert got == sorted(_RETIRING | {("d", None, None, "YEAR_NOT_FOUND")}, key=repr)


def test_lines_are_copied_to_sheets_once(spark):
    from karst.plans.queries import QUERIES

    df = QUERIES["retiring_directors"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, .*nationkey#\d+ = .*nationkey#\d+", plan)) == 1


def test_folders(spark):
    companies = spark.createDataFrame([(1, "Alpha Sdn. Bhd."), (2, "beta"), (3, "gamma")], "k long, name string")
    folders = spark.createDataFrame([("ALPHA SDN BHD",), ("Beta",), ("BETA",), ("gamma",), ("GAMMA",)], "folder string")
    assert {(r.k, r.folder) for r in drafts.folders_of(companies, folders, "k", "name", "folder").collect()} == {(1, "ALPHA SDN BHD"), (2, None), (3, "gamma")}


def test_audit_rows_have_all_columns(spark):
    out = drafts.audit_rows(spark.createDataFrame([("F", "p", 5)], "folder string, path string, total long"), ["total"])
    assert tuple(out.columns) == drafts.AUDIT and out.first().parsed == '{"total":5}' and out.first().sha256 is None


def test_changes_without_a_name_for_their_field(spark):
    text = "SECTION D : CHANGE IN PARTICULAR OF DIRECTOR\nIdentification Number A123 x\nName BOB\nShoe size: 9 01/02/2024\nRace: X 02/02/2024\nIdentification Number 800101-01-1234\nName: EVE 03/02/2024\nSECTION E : x"
    rows, odd = updates.changes(spark.createDataFrame([("p", text), ("q", None), ("r", "none")], "path string, text string"))
    assert {(r.ic, r.name, r.race, r.event_date) for r in rows.collect()} == {("A123", "BOB", "X", dt.date(2024, 2, 2)), ("800101011234", "EVE", None, dt.date(2024, 2, 3))}
    assert [(r.path, r.raw) for r in odd.collect()] == [("p", "Shoe size: 9 01/02/2024")]


def test_duplicates_and_fills(spark):
    from pyspark.sql import functions as F

    people = spark.createDataFrame([("F", "1-2"), ("F", "12"), ("G", ""), ("G", None)], "folder string, ic string")
    assert [tuple(r) for r in drafts.duplicate_people(people, "folder").collect()] == [("F", "12")]
    df = spark.createDataFrame([("", ["", "b", "c"]), ("a", ["b"]), (None, [])], "v string, c array<string>")
    assert [r[0] for r in df.select(drafts.filled(F.col("v"), F.col("c"))).collect()] == ["b", "a", None]
