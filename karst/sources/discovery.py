"""Which files of many folders are meant, told from a listing of paths; and lists of companies that must be whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.sources.tables import require

# What a workbook of retirements is called, and where it lies.
ROTATION, BOOKS, MEETINGS, STATEMENTS = r"(?i)retir|rotation", r"(?i)\.xls[xm]$", "AGM", "fs"
INDEX, MASTER = ("Sequence", "Worksheet", "Folder", "Company Name", "Reg No"), ("Folder", "Company Name", "Reg No")


def _below(path: Column, root: str) -> Column:
    """Parts of a path below the root."""
    return F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), rf"^\Q{root.rstrip('/')}\E/", ""), "/")


def rotation_workbooks(companies: DataFrame, files: DataFrame, folder: str, year: str, root: str = "") -> DataFrame:
    """``companies`` with path and issue: the workbook of retirements of its folder and year.

    ``files`` has a path a file.  It is looked for in the year's folder of the company's
    meetings, and where that has none beside it; several in one place are
    ``rotation_workbook_ambiguous``, none in both ``rotation_workbook_missing``.
    """
    p = _below(F.col("path"), root) if root else F.split("path", "/")
    books = files.select("path", p.alias("p")).where(F.col("path").rlike(BOOKS) & F.element_at("p", -1).rlike(ROTATION) & (F.get("p", F.lit(1)) == MEETINGS) & F.size("p").isin(3, 4))
    # The year's folder has one part more; its number is what a company asks for.
    books = books.select(F.get("p", F.lit(0)).alias("__f"), F.when(F.size("p") == 4, F.get("p", F.lit(2))).otherwise("").alias("__y"), "path")
    places = books.groupBy("__f", "__y").agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("__p"))
    own = places.where("__y <> ''").select("__f", "__y", F.struct("__n", "__p").alias("__own"))
    beside = places.where("__y = ''").select(F.col("__f").alias("__g"), F.struct("__n", "__p").alias("__beside"))
    rows = companies.join(own, (F.col(folder) == F.col("__f")) & (F.col(year).cast("string") == F.col("__y")), "left").join(beside, F.col(folder) == F.col("__g"), "left")
    found = F.coalesce("__own", "__beside")
    issue = F.when(found.isNull(), "rotation_workbook_missing").when(found["__n"] > 1, "rotation_workbook_ambiguous")
    return rows.select(*[rows[c] for c in companies.columns], F.when(found["__n"] == 1, found["__p"]).alias("path"), issue.alias("issue"))


def statement_folders(files: DataFrame, root: str = "") -> DataFrame:
    """folder and place: each company's own folder of statements, called fs in any case; of several the first by name."""
    p = _below(F.col("path"), root) if root else F.split("path", "/")
    rows = files.select(p.alias("p")).where((F.size("p") > 2) & (F.lower(F.get("p", F.lit(1))) == STATEMENTS))
    return rows.groupBy(F.get("p", F.lit(0)).alias("folder")).agg(F.min(F.get("p", F.lit(1))).alias("place"))


def whole_list(rows: DataFrame, columns: tuple[str, ...], unique: str, expected: int) -> DataFrame:
    """``rows`` as text, if it is a list of ``expected`` companies: all columns there, ``unique`` filled and told apart; else an error.

    Rows without any value aren't counted and not given.  One aggregate of constant size decides.
    """
    require(rows, list(columns))
    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    filled = F.array_join(F.array(*[text(c) for c in rows.columns]), "") != ""
    kept = rows.where(filled).select(*[text(c).alias(c) for c in rows.columns])
    u = F.col(f"`{unique}`")
    got = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(u == "").alias("blank"), F.count_distinct(u).alias("d")).first()
    if got.n != expected:
        raise ValueError(f"{expected} companies were to be listed, {got.n} are")
    if got.blank or got.d != got.n:
        raise ValueError(f"{unique} must be filled and unique: {got.blank} blank, {got.d} different of {got.n}")
    return kept
