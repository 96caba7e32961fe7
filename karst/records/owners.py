"""Ownership events: from forms to rows, from wide to long, and who owns now."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions.text import name_key
from karst.functions.values import parse_date, parse_percent
from karst.operators.extract import blocks
from karst.operators.latest import pick
from karst.operators.lookup import guarded_lookup
from karst.operators.reshape import unpivot_slots
from karst.records.companies import q

# Where an event's date is looked for, the percentages, and the key of a repeated event.
DATES = ("Date Received", "PDF Date", "Date of Application", "Date of Data Recorded", "UpdatedAt")
PERCENTAGES = ("Criteria A - Direct Ownership %", "Criteria B - Voting Shares %", "Direct Ownership %", "Indirect Ownership %", "Voting Shares %")
EVENT_KEY = ("Company Name", "Submission No", "BO Status", "Name", "IC", "Direct Ownership %", "Voting Shares %", "Date Received", "PDF Date", "Date of Cessation")
FRIENDLY = {"Direct Ownership %": "Criteria A - Direct Ownership %", "Voting Shares %": "Criteria B - Voting Shares %"}

# The labels of the form and what follows them.
FORM_MARK = "Division 8A, 60B (3), Companies Act 2016"
BLOCK = r"(?i)PARTICULARS\s+OF\s+BENEFICIAL\s+OWNERSHIP"
HEADER = {
    "Submission No": r"Submission Number\s+(\S+)",
    "Date Received": r"Date & Time Received\s+(\d{2}/\d{2}/\d{4})\s+\S+",
    "Time Received": r"Date & Time Received\s+\d{2}/\d{2}/\d{4}\s+(\S+)",
    "Company Name": r"(?i)COMPANY NAME\s+(.+?)(?:\n|$)",
    "Company No": r"(?i)COMPANY NO\s+(.+?)(?:\n|$)",
    "Company Status": r"(?i)STATUS\s+(.+?)(?:\n|$)",
}
FIELDS = {
    "BO Status": r"(?i)STATUS\s+(NEW|CESSATION)",
    "Date of Becoming BO": r"(?i)DATE\s+OF\s+BECOMING\s+BO\s+(\d{2}/\d{2}/\d{4})",
    "Date of Cessation": r"(?i)DATE\s+OF\s+CESSATION\s+(\d{2}/\d{2}/\d{4})",
    "Reason": r"(?is)REASON\s+(.+?)(?:\nTYPE|\nCATEGORY|\nNAME|$)",
    "Date of Data Recorded": r"(?i)DATE\s+OF\s+DATA\s+RECORDED\s+(\d{2}/\d{2}/\d{4})",
    "Type": r"(?i)\nTYPE\s+(INDIVIDUAL|COMPANY|BODY\s+CORPORATE|NOMINEE)",
    "Category": r"(?is)CATEGORY\s+(.+?)(?:\n|$)",
    "Name": r"(?is)NAME\s+(.+?)(?:\n|IDENTIFICATION)",
    "IC": r"(?i)IDENTIFICATION\s+NO\.?\s+(\d{12})",
    "DOB": r"(?i)DATE\s+OF\s+BIRTH\s+(\d{2}/\d{2}/\d{4})",
    "Gender": r"(?i)GENDER\s+(MALE|FEMALE)",
    "Race": r"(?i)RACE\s+([A-Z]+)",
    "Nationality": r"(?i)NATIONALITY\s+([A-Z\s]+?)(?:\s+CITIZENSHIP|\n|$)",
    "Citizenship": r"(?i)CITIZENSHIP\s+([A-Z\s]+?)(?:\n|$)",
    "Designation": r"(?is)DESIGNATION/POSITION\s+IN\s+THE\s+COMPANY\s+(.+?)(?:\nRESIDENTIAL|\nBUSINESS)",
    "Residential Address": r"(?is)RESIDENTIAL\s+ADDRESS\s+(.+?)(?:\nBUSINESS|\nEMAIL)",
    "Business Address": r"(?is)BUSINESS\s+ADDRESS\s+(.+?)(?:\nEMAIL|\nCONTACT)",
    "Email": r"(?i)EMAIL\s+(\S+@\S+)",
    "Contact No": r"(?i)CONTACT\s+NO\.?\s+(\S+)",
    "Type of BO": r"(?is)TYPE\s+OF\s+BO\s+(?!APPLICATION)(.+?)(?:\n|Criteria)",
    "Criteria A - Direct Ownership %": r"(?i)Criteria\s+A\s*[-:]\s*Direct\s+Ownership[:\s]*([\d.]+)",
    "Criteria B - Voting Shares %": r"(?i)Criteria\s+B\s*[-:]\s*Voting\s+Shares[:\s]*([\d.]+)",
    "Criteria C - N/A": r"(?i)Criteria\s+C\s*[-:]\s*([\d.]+|N/A)",
}
DECLARATION = r"(?is)DECLARATION\s+(.*?)(?:ATTENTION|LODGER)"
DECLARED = {"Declaration Name": r"(?i)NAME\s+(.+?)(?:\n|$)", "Date of Application": r"(?i)DATE\s+OF\s+APPLICATION\s+(\d{2}/\d{2}/\d{4})"}
LODGER = r"(?is)LODGER\s+INFORMATION\s+(.*?)(?:SURUHANJAYA|\z)"
LODGED = {"Lodger Name": r"(?i)NAME\s+(.+?)(?:\n|$)", "Lodger IC": r"(?i)IDENTIFICATION\s+NO\.?\s+(\d{12})", "Lodger Email": r"(?i)EMAIL\s+ADDRESS\s+(\S+)", "Lodger Phone No": r"(?i)PHONE\s+NO\.?\s+(\S+)"}


def _found(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s+", " "))


def parse_forms(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A row for each owner's block of each form; header, company, declaration and lodger go to every row.

    Texts that are no forms, and blocks without an identity number, give nothing.
    A missing field is an empty text.  Expressions only; no shuffle.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = files.where(F.contains(t, F.lit(FORM_MARK)))
    declared, lodged = F.regexp_extract(t, DECLARATION, 1), F.regexp_extract(t, LODGER, 1)
    rows = rows.select(
        F.element_at(F.split(path, "/"), -1).alias("Source PDF"),
        *[_found(t, p).alias(n) for n, p in HEADER.items()],
        *[_found(declared, p).alias(n) for n, p in DECLARED.items()],
        *[_found(lodged, p).alias(n) for n, p in LODGED.items()],
        t.alias("__karst_text"),
    )
    rows = blocks(rows, "__karst_text", BLOCK).drop("pos")
    return rows.select(*[q(c) for c in rows.columns if c != "block"], *[_found(F.concat(F.lit("\n"), F.col("block")), p).alias(n) for n, p in FIELDS.items()]).where("IC <> ''")


def consolidate(events: DataFrame) -> DataFrame:
    """Events once each, numbered newest first within their company (``slot``).

    Two events are one if all fields but the source agree; the least source name
    stays.  Companies are one by number, else by name.
    """
    rest = [c for c in events.columns if c != "Source PDF"]
    once = events.groupBy(*[q(c) for c in rest]).agg(F.min(q("Source PDF")).alias("Source PDF"))
    company = F.when(name_key(q("Company No")) != "", F.concat(F.lit("REG:"), name_key(q("Company No")))).otherwise(F.concat(F.lit("COMPANY:"), name_key(q("Company Name"))))
    at = F.coalesce(*[parse_date(q(c)) for c in DATES if c in events.columns])
    once = once.withColumn("company", company).withColumn("at", at)
    w = Window.partitionBy("company").orderBy(F.desc_nulls_last("at"), q("Submission No"), q("Source PDF"), *[q(c) for c in rest])
    return once.withColumn("slot", F.row_number().over(w)).drop("at")


def to_long(wide: DataFrame) -> DataFrame:
    """``BO{n} field`` groups as rows that inherit the company's name and number where theirs are blank."""
    keep = [c for c in ("Company", "Company Name", "Company No", "Company Status", "UpdatedAt") if c in wide.columns]
    held = wide.withColumnsRenamed({c: f"Master {c}" for c in keep})
    rows = unpivot_slots(held, "BO", "Name", [f"Master {c}" for c in keep])
    filled = lambda c: F.coalesce(F.nullif(F.trim(q(c)), F.lit("")), q(f"Master {c}")) if c in rows.columns else q(f"Master {c}")
    return rows.withColumns({c: filled(c) for c in keep})


class Owners:
    """``events``: long ownership events with an ordinal column."""

    def __init__(self, events: DataFrame, ordinal: str):
        key = [c for c in EVENT_KEY if c in events.columns]
        self.ordinal = ordinal
        self.raw = pick(events, [f"`{c}`" for c in key], [F.desc(ordinal)])

    def _has(self, c: str) -> bool:
        return c in self.raw.columns

    def _text(self, c: str) -> Column:
        return F.coalesce(F.trim(q(c)), F.lit("")) if self._has(c) else F.lit("")

    def _graded(self) -> DataFrame:
        """Events with who and which company they are about, and what they are ranked by."""
        status, ceased = F.upper(self._text("BO Status")), parse_date(q("Date of Cessation")) if self._has("Date of Cessation") else F.lit(None).cast("date")
        ends = (status == "CESSATION") | ((status == "") & ceased.isNotNull())
        dates = [parse_date(q(c)) for c in DATES if self._has(c)]
        shares = [parse_percent(q(c)) for c in PERCENTAGES if self._has(c)]
        names = [name_key(self._text(c)) for c in ("Master Company Name", "Company Name") if self._has(c)]
        number = self._text("Master Company No") if self._has("Master Company No") else self._text("Company No")
        return self.raw.withColumns({
            "__who": F.when(self._text("IC") != "", self._text("IC")).otherwise(name_key(self._text("Name"))),
            "__company": F.when(number != "", number).otherwise(F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(""))),
            "__filed": F.coalesce(*dates, F.lit("1900-01-01").cast("date")),
            "__submission": F.upper(self._text("Submission No")),
            "__ends": ends,
            "__grade": F.when(status == "NEW", 3).when(ends, 1).otherwise(2),
            "__share": F.greatest(*shares, F.lit(0.0)) if shares else F.lit(0.0),
        })

    def _done(self, df: DataFrame) -> DataFrame:
        out = df.drop(*[c for c in df.columns if c.startswith("__")])
        return out.withColumns({a: q(b) for a, b in FRIENDLY.items() if b in out.columns and a not in out.columns})

    def of_company(self, name: str) -> DataFrame:
        """Events of the company that the name means, and of companies of the same number."""
        key = name_key(F.lit(name))
        mine = guarded_lookup(self._graded(), F.coalesce(F.nullif(name_key(self._text("Master Company Name")), F.lit("")), name_key(self._text("Company Name"))), key)
        return self._graded().join(mine.select("__company").distinct(), "__company", "left_semi")

    def current(self, name: str | None = None) -> DataFrame:
        """The last event of each owner in each company, unless it ends the ownership.

        Last by filing date, submission, kind (new, other, ceased), share and row; the
        filter comes after the ranking.
        """
        rows = (self._graded() if name is None else self.of_company(name)).where("__who <> ''")
        last = pick(rows, ["__company", "__who"], [F.desc("__filed"), F.desc("__submission"), F.desc("__grade"), F.desc("__share"), F.desc(self.ordinal)])
        return self._done(last.where("not __ends").orderBy("__company", "Name"))

    def history(self, person: str) -> DataFrame:
        """A person's events: companies up, dates down, undated last."""
        rows = self._graded().where((name_key(F.col("Name")) == name_key(F.lit(person))) & (name_key(F.lit(person)) != ""))
        dates = [parse_date(q(c)) for c in DATES if self._has(c)]
        rows = rows.withColumn("__d", F.coalesce(*dates)).orderBy("__company", F.desc_nulls_last("__d"), F.asc_nulls_last(self.ordinal))
        return self._done(rows)

    def names(self, column: str) -> DataFrame:
        """Distinct names, first spelling, in the order of first sight."""
        rows = self.raw.select(q(column).alias(column), self.ordinal, name_key(q(column)).alias("k")).where("k <> ''")
        return pick(rows, ["k"], [F.asc(self.ordinal)]).orderBy(self.ordinal).select(column)


def active_on(events: DataFrame, day: Column) -> DataFrame:
    """Owners from their day of becoming until before their day of ceasing."""
    a, b = parse_date(q("Date of Becoming BO")), parse_date(q("Date of Cessation"))
    return events.where((a <= day) & (b.isNull() | (b > day)))


def widen(events: DataFrame, fields: list[str], most: int) -> DataFrame:
    """Consolidated events as one row a company with ``BO{n} field`` columns."""
    cells = reduce(lambda a, n: a + [F.max(F.when(F.col("slot") == n, q(f))).alias(f"BO{n} {f}") for f in fields], range(1, most + 1), [])
    head = [F.max_by(q(c), -F.col("slot")).alias(c) for c in ("Company Name", "Company No", "Company Status")]
    return events.groupBy("company").agg(*head, *cells)
