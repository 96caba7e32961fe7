"""Statutory filings: what a text is, whether it counts, and the state it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions.once import once, worked_out
from karst.functions.text import clean, registration_tokens
from karst.functions.values import parse_date
from karst.operators.extract import first_rule
from karst.operators.ledger import keep_best

# Rules in order, and the order of sections on one day.
SECTIONS = {
    "S51": r"(?s)^(?=.*\bSECTION\s*51(?!\d))(?=.*REGISTER\s+OF\s+MEMBERS?)",
    "S78": r"(?s)^(?=.*\bSECTION\s*78(?!\d))(?=.*RETURN OF ALLOTMENT)",
    "S58": r"(?s)^(?=.*\bSECTION\s*58(?!\d))(?=.*(?:NOTIFICATION OF CHANGE|DIRECTOR))",
    "S68": r"(?s)^(?=.*ANNUAL RETURN)(?=.*(?:\bSECTION\s*68(?!\d)|AR1))",
}
LATER_SECTIONS = {
    "S78": r"(?s)^(?=.*\bFORM\s*24(?!\d))(?=.*(?:ALLOTMENT|SHARE))",
    "FORM49": r"(?s)^(?=.*\bFORM\s*49(?!\d))(?=.*(?:DIRECTOR|SECRETARY))",
}
PRECEDENCE = {"S14": 10, "FORM49": 15, "S68": 20, "S51": 30, "S58": 40, "S78": 40}
PROFILE = ("S14", "S68")
EXCLUDED = r"(?i)(?:^|[\\/ _-])(draft|receipt|invoice|authority|confirmation|email|gmail|resolution|dwr|mwr|bill)(?:$|[\\/ _().-])"
PREFERRED = r"(?i)(approved|approval|lodged|registered|certified|ctc)"
_DATE = r"(\d{2}[/-]\d{2}[/-]\d{4}|\d{4}-\d{2}-\d{2})"
SUBMITTED = (rf"(?i)(?:Submission|Submitted)\s+Date\s*:?\s*{_DATE}", rf"(?i)Date\s+of\s+Lodgement\s*:?\s*{_DATE}", rf"(?i)Date\s+of\s+Submission\s*:?\s*{_DATE}")
ENCODED = r"(?i)(?:ROM|CPO|ROA|XBAR|CIU[-\s]*COU)\s*(\d{8})"
REFERENCES = (r"(?i)(?:Lodging|Lodgement)\s+Reference\s+(?:Number|No\.?)\s*:?\s*([A-Z0-9-]+)", r"(?i)Reference\s+(?:Number|No\.?)\s*:?\s*([A-Z0-9-]+)")
REGISTRATION = r"(?i)Registration\s*No\.?\s*:?\s*([^\n]+)"
OFFICER = r"(?i)(?:^|\n)\s*(ADD|CEASE)\s+DIRECTOR\s*(?=\n|$)"
OFFICER_FIELDS = {
    "Name": r"Name", "IC": r"Identification\s+No\.?", "ID Type": r"Identification\s+Type", "Nationality": r"Nationality\s+Country", "Citizenship": r"Citizenship", "DOB": r"Date\s+of\s+Birth",
    "Race": r"Race", "Gender": r"Gender", "Residential": r"Residential\s+Address", "Service Address": r"Service\s+Address", "Contact No": r"Phone\s+Number", "Email": r"Email\s+Address",
    "Appointment Date": r"Date\s+of\s+Appointment", "Date of Cessation": r"Date\s+of\s+Cessation", "Cessation Reason": r"Type\s+of\s+Cessation",
}


def section(text: Column) -> Column:
    """The first rule that fits; texts of section 14 are told with all blanks left out."""
    def s14(compact: Column) -> Column:
        has = lambda x: F.contains(compact, F.lit(x))
        return has("APPLICATIONFORREGISTRATIONOFACOMPANY") | (has("SECTION14") & has("PARTICULARSOFCOMPANY"))

    def told(upper: Column) -> Column:
        form = once(F.upper(F.regexp_replace(text, r"\s+", "")), s14)
        return once(first_rule(upper, SECTIONS, ""), lambda early: F.when(early != "", early).when(form, "S14").otherwise(first_rule(upper, LATER_SECTIONS, "OTHER")))

    return once(F.upper(clean(text)), told)


def section_rank(c: Column) -> Column:
    out = F.lit(0)
    for name, n in PRECEDENCE.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def excluded(path: Column) -> Column:
    return path.rlike(EXCLUDED) & ~path.rlike(PREFERRED)


def quality(path: Column) -> Column:
    return F.when(path.rlike(PREFERRED), 3).otherwise(2)


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[once(F.regexp_extract(text, p, 1), lambda x: F.when(x != "", x)) for p in patterns])


def lodgement(text: Column, path: Column) -> Column:
    """struct(date, source): from the document, else a reference, else the file name."""
    from karst.functions.values import source_date

    told = lambda date, source: F.struct(date.alias("date"), F.lit(source).alias("source"))
    name = once(source_date(path), lambda d: F.when(d.isNotNull(), told(d, "FILENAME")).otherwise(told(d, "")))
    reference = once(F.try_to_date(F.regexp_extract(text, ENCODED, 1), "ddMMyyyy"), lambda d: F.when(d.isNotNull(), told(d, "REFERENCE")).otherwise(name))
    return once(once(_first(text, SUBMITTED), lambda x: parse_date(x)), lambda d: F.when(d.isNotNull(), told(d, "DOCUMENT")).otherwise(reference))


def read(files: DataFrame) -> DataFrame:
    """Filing records of texts: ``files`` has folder, path, text and sha256."""
    t, p = F.coalesce("text", F.lit("")), F.col("path")
    # Section and date are read in each text once, whatever asks for them later.
    rows = worked_out(files.select("folder", "path", "sha256", "text"), section=section(t), __at=lodgement(t, p))
    blank = F.length(F.trim(t)) == 0
    status = F.when(excluded(p), "EXCLUDED").when(blank, "UNREADABLE").when(F.col("section") == "OTHER", "OTHER").otherwise("VALID")
    return rows.select("folder", "path", "sha256", "section", status.alias("status"), quality(p).alias("quality"), registration_tokens(F.regexp_extract(t, REGISTRATION, 1)).alias("registrations"), F.upper(F.coalesce(_first(t, REFERENCES), F.lit(""))).alias("reference"), F.col("__at.date").alias("lodged"), F.col("__at.source").alias("lodged_from"), "text")


def canonicalise(records: DataFrame) -> DataFrame:
    """Records with their final status: of copies by content, then by reference, the best stays; then other companies' papers go.

    The company of a folder is the registration number of most of its valid profile
    filings (all, if it has none), ties to the latest.  A number's owner may have
    an old and a new number: records that share one with the majority stay.
    """
    order = [F.desc_nulls_last("lodged"), section_rank(F.col("section")).desc(), F.desc("quality"), F.desc("reference"), F.desc("path")]
    live = lambda df: df.where("status = 'VALID'")
    rest = records.where("status <> 'VALID'")
    rows = keep_best(live(records), ["folder", "sha256"], order)
    once = keep_best(live(rows).withColumn("number", F.coalesce(F.get("registrations", F.lit(0)), F.lit(""))), ["folder", "section", "number", "reference"], order).drop("number")
    one = live(once).where(F.size("registrations") > 0).withColumn("number", F.array_join(F.array_sort("registrations"), "/"))
    w = Window.partitionBy("folder")
    one = one.withColumn("profile", F.col("section").isin(*PROFILE)).withColumn("any", F.max("profile").over(w)).where("profile or not any")
    votes = one.groupBy("folder", "number").agg(F.count("*").alias("n"), F.max("lodged").alias("d"), F.first("registrations").alias("own"))
    own = votes.groupBy("folder").agg(F.max_by("own", F.struct("n", F.coalesce("d", F.lit("1900-01-01").cast("date")), "number")).alias("own"))
    wrong = (F.size("registrations") > 0) & ~F.coalesce(F.arrays_overlap("registrations", "own"), F.lit(True))
    judged = once.join(own, "folder", "left").withColumn("status", F.when((F.col("status") == "VALID") & wrong, "REG_MISMATCH").otherwise(F.col("status"))).drop("own")
    return judged.unionByName(rows.where("status <> 'VALID'")).unionByName(rest)


def officer_events(records: DataFrame) -> DataFrame:
    """APPOINT and CEASE rows of change-of-director filings, a row a block; blocks without name and number give none."""
    t = F.concat(F.lit("\n"), F.coalesce(F.regexp_extract("text", r"(?is)\bDIRECTORS\b(.*?)(?=\bLODGER\s+INFORMATION\b|\z)", 1), F.lit("")))
    kinds = F.regexp_extract_all(t, F.lit(OFFICER), F.lit(1))
    parts = F.slice(F.split(t, OFFICER, -1), 2, 2**30)
    rows = records.where("section = 'S58'").select("folder", "path", "section", "lodged", F.explode(F.arrays_zip(kinds.alias("kind"), parts.alias("block"))).alias("e"))
    stop = "|".join([*OFFICER_FIELDS.values(), r"Upload\s+Resolution", r"Other\s+Information", "Declaration", r"Personal\s+Details", r"Record\s+Details", "Notes"])
    value = lambda label: F.trim(clean(F.regexp_extract(F.concat(F.lit("\n"), F.col("e.block")), rf"(?is)\n\s*{label}\s+(.*?)(?=\n\s*(?:{stop})\b|\z)", 1)))
    out = rows.select("folder", "path", "section", "lodged", F.when(F.upper("e.kind") == "ADD", "APPOINT").otherwise("CEASE").alias("event"), *[value(p).alias(n) for n, p in OFFICER_FIELDS.items()])
    at = F.when(F.col("event") == "APPOINT", F.col("`Appointment Date`")).otherwise(F.col("`Date of Cessation`"))
    return out.withColumn("event_date", parse_date(at)).where("Name <> '' OR IC <> ''")


def issues(records: DataFrame) -> DataFrame:
    """An issue row for every record that doesn't count and needs a look."""
    code = F.when(F.col("status") == "UNREADABLE", "UNREADABLE_FILING").when(F.col("status") == "REG_MISMATCH", "REGISTRATION_MISMATCH")
    severity = F.when(F.col("status") == "REG_MISMATCH", "CRITICAL").otherwise("REVIEW")
    return records.select("folder", severity.alias("severity"), code.alias("code"), F.col("path").alias("source_path"), "section", F.col("lodged").alias("effective_date")).where("code is not null")
