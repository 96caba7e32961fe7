"""Dated changes of directors' particulars in older notifications: a person a block, a change a line, with its date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import clean, identity_key
from karst.functions.values import parse_date
from karst.operators.extract import first_rule

# What a changed field is called on the form.
CHANGED = {
    "name": r"(?i)^(?:full\s+)?name\b", "ic": r"(?i)identification|passport|nric|mykad", "residential": r"(?i)residential", "service_address": r"(?i)service\s+address|business\s+address", "nationality": r"(?i)nationality|citizenship", "race": r"(?i)^race\b",
    "gender": r"(?i)gender|sex\b", "dob": r"(?i)date\s+of\s+birth", "email": r"(?i)e-?mail", "contact_no": r"(?i)phone|contact|mobile", "designation": r"(?i)designation|position",
}
BLOCK = r"(?is)SECTION\s+[A-Z]\s*:\s*CHANGE\s+IN\s+PARTICULARS?\s+OF\s+DIRECTOR\s+(.*?)(?:SECTION\s+[A-Z]\s*:|PARTICULARS\s+OF\s+LODGER|\z)"
LINE = r"(?im)^[ \t]*(.+?)[ \t]*:[ \t]*(.+?)[ \t]+(\d{2}/\d{2}/\d{4})[ \t]*$"


def identifier(c: Column) -> Column:
    """The twelve digits of a number, else its first word without marks."""
    twelve = F.regexp_extract(F.regexp_replace(c, r"[\s-]", ""), r"(\d{12})", 1)
    return F.when(twelve != "", twelve).otherwise(identity_key(F.get(F.split(F.trim(c), r"\s+"), F.lit(0))))


def changes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updates, diagnostics) of ``files`` (path, text).

    Updates: path, ic, name, event_date and a column for each field of ``CHANGED``, one
    row a person and date.  Diagnostics: path, date and raw of dated lines whose field
    has no name here.
    """
    block = F.regexp_extract(F.coalesce("text", F.lit("")), BLOCK, 1)
    people = files.select("path", F.explode(F.split(block, r"(?i)(?=Identification\s+Number)")).alias("b")).where(F.col("b").rlike(r"(?i)^Identification\s+Number"))
    people = people.select("path", identifier(F.regexp_extract("b", r"(?i)^Identification\s+Number\s*:?\s*([^\n]+)", 1)).alias("who"), clean(F.regexp_extract("b", r"(?im)^\s*Name\s+(?!.*\d{2}/\d{2}/\d{4})([^\n]+)$", 1)).alias("called"), "b")
    part = lambda i: F.regexp_extract_all("b", F.lit(LINE), F.lit(i))
    lines = people.select("path", "who", "called", F.explode(F.arrays_zip(part(0).alias("raw"), part(1).alias("label"), part(2).alias("value"), part(3).alias("day"))).alias("e")).select("path", "who", "called", "e.*")
    lines = lines.withColumn("field", first_rule(F.col("label"), CHANGED, "")).withColumn("day", parse_date(F.col("day")))
    own = lines.where("field <> '' and day is not null").groupBy("path", "who", "called", "day").agg(*[F.max(F.when(F.col("field") == f, clean(F.col("value")))).alias(f) for f in CHANGED])
    rows = own.select("path", F.coalesce("ic", "who").alias("ic"), F.coalesce("name", "called").alias("name"), F.col("day").alias("event_date"), *[f for f in CHANGED if f not in ("ic", "name")])
    return rows, lines.where("field = '' or day is null").select("path", F.col("day").alias("date"), F.trim("raw").alias("raw"))
