"""Single papers of a folder: the ones of a section with their dates, the latest, and what a folder's first papers date it to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import identity_key
from karst.functions.values import parse_date
from karst.records import filings, parse
from karst.records.candidates import file_name

# How papers of a section are told by name, and labels of the dates that count after those of the filing itself.
NAMED = {"S51": r"(?i)section 51|sec51", "S58": r"(?i)section 58|sec58", "S14": r"(?i)section 14|section 17|sec14|sec17|superform 14"}
APPOINTED, CEASED = r"(?i)Date\s+Of\s+Appointment\s+(\d{2}/\d{2}/\d{4})", r"(?i)Date of Cessation\s+(\d{2}/\d{2}/\d{4})"
KINDS = (r"(?i)(?:section|sec)\s*17\b", r"(?i)^\s*(?:section|sec)\s*14\s*$", r"(?i)superform 14")


def _told(text: Column, section: str) -> Column:
    own = F.coalesce(*[parse_date(F.regexp_extract(text, p, 1)) for p in filings.SUBMITTED], F.try_to_date(F.regexp_extract(text, filings.ENCODED, 1), "ddMMyyyy"))
    if section == "S58":
        return F.coalesce(own, parse_date(F.regexp_extract(text, APPOINTED, 1)), parse_date(F.regexp_extract(text, CEASED, 1)))
    return own if section == "S51" else parse_date(parse.value(text, "annual_return_date"), ("d/M/yyyy",))


def dated(files: DataFrame, section: str) -> DataFrame:
    """folder, path and date of the folder's papers of a section (S51, S58 or S68), those without a date left out.

    Registers and notifications are told by name, and notifications must speak of a
    director; returns are told by their text and dated by day, month and year.
    """
    t = F.coalesce("text", F.lit(""))
    up = F.upper(t)
    fits = {"S51": F.col("path").rlike(NAMED["S51"]), "S58": F.col("path").rlike(NAMED["S58"]) & F.contains(up, F.lit("DIRECTOR")), "S68": up.rlike("SECTION 68|AR1")}[section]
    if section != "S68":
        fits = file_name(F.col("path")).rlike(NAMED[section]) & fits
    return files.where(fits).select("folder", "path", _told(t, section).alias("date")).where("date is not null")


def listed(files: DataFrame, section: str) -> DataFrame:
    """``dated`` with ``nth``, the place in its folder by date, then path: dates and paths alone are sorted, never texts."""
    one = dated(files, section).groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("date", "path"))).alias("p"))
    return one.select("folder", F.posexplode("p").alias("nth", "e")).select("folder", "nth", "e.path", "e.date")


def latest(files: DataFrame, section: str) -> DataFrame:
    """folder, path and date of the latest paper of a section; of one day the first path."""
    last = dated(files, section).groupBy("folder").agg(F.max("date").alias("date"), F.min_by("path", F.struct(F.datediff(F.lit("9999-12-31").cast("date"), "date"), "path")).alias("path"))
    return last.select("folder", "path", "date")


def replaces(register: Column, base: Column, members: Column) -> Column:
    """Whether a register's members stand for those of the profile: it has some, and a date that is later than the profile's, if that has one."""
    return F.coalesce((members > 0) & register.isNotNull() & (base.isNull() | (register > base)), F.lit(False))


def incorporated(files: DataFrame) -> DataFrame:
    """folder and date: of the papers of an incorporation (by name) that tell a date the most specific kind counts, then the smallest file, then the first path."""
    name = F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "")
    kind = F.lit(len(KINDS))
    for i, p in reversed(list(enumerate(KINDS))):
        kind = F.when(name.rlike(p), i).otherwise(kind)
    rows = files.where(file_name(F.col("path")).rlike(NAMED["S14"])).select("folder", "path", "size", kind.alias("kind"), parse.incorporation_date(F.coalesce("text", F.lit(""))).alias("date"))
    return rows.where("date is not null").groupBy("folder").agg(F.min_by("date", F.struct("kind", "size", F.lower("path"))).alias("date"))


def reference_conflicts(records: DataFrame) -> DataFrame:
    """An issue for each filing whose reference a better one of other content has in its folder, section and number.

    ``records`` are filings as ``filings.read`` gives them, copies by content left out;
    better is what ``filings.canonicalise`` keeps.
    """
    order = F.struct(F.coalesce("lodged", F.lit("0001-01-01").cast("date")), filings.section_rank(F.col("section")), "quality", "path")
    rows = records.where("status = 'VALID' AND reference <> ''").withColumn("number", F.coalesce(F.get("registrations", F.lit(0)), F.lit(""))).withColumn("at", order)
    best = rows.groupBy("folder", "section", "number", "reference").agg(F.max("at").alias("top"), F.max_by("sha256", "at").alias("own"))
    lost = rows.join(best, ["folder", "section", "number", "reference"]).where("at < top AND sha256 <> own")
    return lost.select("folder", F.lit("REVIEW").alias("severity"), F.lit("FILING_REFERENCE_CONFLICT").alias("code"), F.col("path").alias("source_path"), "section", F.col("lodged").alias("effective_date"))


def signers(statements: DataFrame, directors: DataFrame, fields: list[str]) -> DataFrame:
    """company, field, name, gender and issue: each named field of a statement against the company's directors (company, Name, Gender).

    A blank name is ``missing_fs_field``, one that no director has ``director_mismatch``, and
    a director who is neither MALE nor FEMALE ``missing_director_gender``.  Of directors of one name
    the last by slot counts.
    """
    asked = statements.select("company", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f"`{f}`")).alias("name")) for f in fields])).alias("e")).select("company", "e.*")
    known = directors.groupBy("company", identity_key(F.col("Name")).alias("k")).agg(F.max_by(F.struct(F.col("Name").alias("called"), F.upper(F.trim(F.col("Gender"))).alias("gender")), "slot").alias("d"))
    out = asked.withColumn("k", identity_key(F.coalesce("name", F.lit("")))).join(known, ["company", "k"], "left")
    issue = F.when(F.coalesce("name", F.lit("")) == "", "missing_fs_field").when(F.col("d").isNull(), "director_mismatch").when(~F.coalesce(F.col("d.gender"), F.lit("")).isin("MALE", "FEMALE"), "missing_director_gender")
    return out.select("company", "field", F.when(issue.isNull(), F.col("d.called")).alias("name"), F.when(issue.isNull(), F.col("d.gender")).alias("gender"), issue.alias("issue"))
