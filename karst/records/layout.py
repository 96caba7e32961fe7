"""Registers told apart by columns on the page: directors and members of a return whose text keeps its character columns.

A file's text has its pages apart by form feeds.  A table's head says where its columns
start; a page of another width, and a row whose values stand elsewhere, move them: values
that give their column away (``marks``) are set against the headings, and a line through
the first and the last of them moves the rest.  A row opens with its number and goes on
over lines and pages until the next one.

Lines of a file are ordered in one window; what is in force at a line (the head, the
columns, the row) is the last one before it.  Positions count UTF-16 units.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions.text import identity_key
from karst.records.candidates import layout_address, layout_value, repaired_identities

# What marks the papers, sexes, countries and holders in a row, and lines that belong to the page.
PAPER = r"(?i)(?:MYKAD|NRIC|PASSPORT)"
COUNTRY = r"(?i)\b(?:MALAYSIA|CHINA|INDIA|SINGAPORE)\b"
GENDER = r"(?i)\b(?:MALE|FEMALE)\b"
HOLDER = r"(?i)\b(?:INDIVIDUAL|BODY\s+CORPORATE|COMPANY)\b"
CITIZENS = r"(?i)\b(?:CITIZENS|NON\s*-?\s*CITIZENS)\b"
PAGE_LINES = r"(?i)Company\s+No\s*:|Page\s+\d+\s+of\s+\d+|Title/Name|Date\s+of\s+birth|expiry\s+date"
LEAKED = r"(?i)Company\s+No\s*:|Page\s+\d+\s+of\s+\d+|Particulars\s+of"


class Columns(NamedTuple):
    """A table on pages: where it begins and ends, how a row opens, and its columns.

    ``headings`` are looked for in the ``head`` lines from the beginning on, or as many as
    there are before the first row, the leftmost match counts; a pair (pattern, column) is looked for right of that column.  ``marks``
    are values in a row's first line, from left to right.  ``follows`` gives columns that
    start with the first text after the mark of another.  ``every`` row is fitted anew, else
    only those on pages of another width than the head's.  ``amount`` is (column, from,
    before): it starts at the last number between two columns.
    """

    begins: str
    ends: str
    opens: str
    head: int
    headings: dict[str, str | tuple[str, str]]
    marks: dict[str, str]
    follows: dict[str, str] = {}
    every: bool = False
    amount: tuple[str, str, str] | None = None
    unread: tuple[str, ...] = ()


# Headings of the return's two tables.
DIRECTORS = Columns(
    r"(?i)Particulars\s+of\s+Directors", r"(?i)Particulars\s+of\s+Managers", r"^\s*\d{4}\b", 8,
    {
        "name": r"(?i)Title/Name", "designation": r"(?i)Designation", "identity": (r"(?i)\bType\b", "designation"), "passport": r"(?i)Passport", "nationality": r"(?i)Nationality",
        "gender": r"(?i)Gender", "dob": r"(?i)Date\s+of\s+birth", "residential": r"(?i)Residential", "service": r"(?i)Service", "business": r"(?i)Business",
    },
    {"designation": r"(?i)\bDIRECTOR\b", "identity": PAPER, "nationality": COUNTRY, "gender": GENDER, "dob": r"\b\d{4}-\d{2}-\d{2}\b"},
)
MEMBERS = Columns(
    r"(?i)SECTION\s+E\s*:.*PARTICULARS\s+OF\s+MEMBERS", r"(?i)TOTAL\s+NUMBER\s+OF\s+SHARES|SECTION\s+F", r"^\s*\d{4}\s+\d{4}\b", 10,
    {
        "reference": r"(?i)Reference", "member_type": r"(?i)Type\s+of", "name": r"(?i)Title/Name", "identity": (r"(?i)Type/|Type\s*/Identification", "name"), "passport": r"(?i)Passport", "nationality": r"(?i)Nationality",
        "gender": r"(?i)Gender", "dob": r"(?i)Date\s+of\s+birth", "address": r"(?i)Address", "shares": (r"(?i)Number\s+of", "address"), "analysis": r"(?i)Analysis",
    },
    {"member_type": HOLDER, "identity": PAPER, "nationality": COUNTRY, "gender": GENDER, "dob": r"\b\d{2}/\d{2}/\d{4}\b", "analysis": CITIZENS},
    {"name": "member_type", "address": "dob"}, every=True, amount=("shares", "address", "analysis"), unread=("reference",),
)


def _tail(line: Column, at: Column) -> Column:
    return F.substring(line, at + 1, F.length(line))


def heading_at(lines: Column, pattern: str, after: Column | None = None) -> Column:
    """The leftmost place (from 0) of a heading in any of the lines, right of ``after``; null if no line has it."""
    least = F.lit(0) if after is None else after + 1
    return F.array_min(F.transform(lines, lambda x: F.nullif(F.regexp_instr(_tail(x, least), F.lit(pattern)), F.lit(0)) + least - 1))


def _heads(lines: DataFrame, t: Columns) -> DataFrame:
    """``lines`` with ``head``: places of all headings and the page's width where a table begins and no heading lacks, else null."""

    lines = lines.withColumn("__head", F.when(F.col("text").rlike(t.begins), F.slice("page_lines", F.col("line") + 1, F.lit(t.head))))
    # In a short table the first rows are among these lines, and their words are no headings.
    row = F.array_position(F.transform("__head", lambda x: x.rlike(t.opens)), F.lit(True)).cast("int")
    lines = lines.withColumn("__head", F.when(row > 0, F.slice("__head", F.lit(1), row - 1)).otherwise(F.col("__head")))
    lines = lines.withColumns({f"__{n}": heading_at(F.col("__head"), p) for n, p in t.headings.items() if isinstance(p, str)})
    lines = lines.withColumns({f"__{n}": heading_at(F.col("__head"), p[0], F.col(f"__{p[1]}")) for n, p in t.headings.items() if not isinstance(p, str)})
    names = [f"__{n}" for n in t.headings]
    whole = F.col("__head").isNotNull()
    for n in names:
        whole = whole & F.col(n).isNotNull()
    found = F.struct(*[F.col(f"__{n}").cast("double").alias(n) for n in t.headings], F.col("width").alias("width"))
    return lines.withColumn("head", F.when(whole, found)).drop("__head", *names)


def _fitted(lines: DataFrame, t: Columns) -> DataFrame:
    """``lines`` with ``starts``: where the columns of ``base`` stand, by the values of ``probe``."""
    probe, seen = F.col("probe"), F.lit(0)
    out = lines.withColumn("__ratio", F.when(F.col("base.width") > 0, F.col("width") / F.col("base.width")).otherwise(F.lit(1.0)))
    for i, (name, p) in enumerate(t.marks.items(), 1):
        out = out.withColumn(f"__m_{name}", seen + F.nullif(F.regexp_instr(_tail(probe, seen), F.lit(p)), F.lit(0)) - 1)
        seen = F.coalesce(F.greatest(F.lit(-1), *[F.col(f"__m_{n}") for n in list(t.marks)[:i]]) + 1, F.lit(0))
    was = lambda n: F.col(f"base.{n}") * F.col("__ratio")
    pairs = F.filter(F.array(*[F.struct(was(n).alias("was"), F.col(f"__m_{n}").alias("now")) for n in t.marks]), lambda x: x["now"].isNotNull())
    out = out.withColumn("__pairs", pairs).withColumns({"__first": F.get("__pairs", F.lit(0)), "__last": F.get("__pairs", F.size("__pairs") - 1)})
    fits = F.col("__first.was") != F.col("__last.was")
    slope = F.when(fits, (F.col("__last.now") - F.col("__first.now")) / (F.col("__last.was") - F.col("__first.was"))).otherwise(F.lit(1.0))
    out = out.withColumn("__slope", slope).withColumn("__shift", F.when(fits, F.col("__first.now") - F.col("__slope") * F.col("__first.was")).otherwise(F.lit(0.0)))
    places = {}
    for name in t.headings:
        at = F.bround(was(name) * F.col("__slope") + F.col("__shift")).cast("int")
        if t.every and name in t.marks:
            at = F.coalesce(f"__m_{name}", at)
        if name in t.follows:
            mark = F.col(f"__m_{t.follows[name]}")
            end = mark + F.length(F.regexp_extract(_tail(probe, mark), t.marks[t.follows[name]], 0))
            at = F.coalesce(end + F.nullif(F.regexp_instr(_tail(probe, end), F.lit(r"\S")), F.lit(0)) - 1, at)
        places[f"__at_{name}"] = F.when(F.col(f"base.{name}") == 0, 0).otherwise(at)
    out = out.withColumns(places)
    if t.amount:
        name, left, right = t.amount
        part = F.substring(probe, F.col(f"__at_{left}") + 1, F.col(f"__m_{right}") - F.col(f"__at_{left}"))
        digits = F.nullif(F.regexp_instr(part, F.lit(r"(?:\d(?:\s{1,2}\d)+|\d+)(?=\D*$)")), F.lit(0))
        out = out.withColumn(f"__at_{name}", F.coalesce(F.col(f"__at_{left}") + digits - 1, F.col(f"__at_{name}")))
    starts = F.array_sort(F.array(*[F.struct(F.col(f"__at_{n}").cast("int").alias("at"), F.lit(n).alias("name")) for n in t.headings], F.struct(F.lit(0).alias("at"), F.lit("number").alias("name"))))
    return out.withColumn("starts", F.when(probe.isNotNull() & F.col("base").isNotNull(), starts)).drop(*[c for c in out.columns if c.startswith("__")])


def cells(files: DataFrame, t: Columns) -> DataFrame:
    """A row for each row of the table in files (path, text): path, pos and an array of texts for each column.

    A table of which a heading lacks gives nothing, and so does a null or empty text.
    Rows of one path are one file; a file given twice must have two paths.
    """
    pages = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("page", "body")).withColumn("page_lines", F.split("body", r"\r?\n"))
    pages = pages.withColumn("width", F.array_max(F.transform("page_lines", lambda x: F.length(x)))).withColumn("first_row", F.get(F.filter("page_lines", lambda x: x.rlike(t.opens)), F.lit(0)))
    pages = pages.where("width > 0")
    lines = _heads(pages.select("path", "page", "page_lines", "width", "first_row", F.posexplode("page_lines").alias("line", "text")), t).drop("page_lines")
    order = Window.partitionBy("path").orderBy("page", "line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("base", F.coalesce("head", F.last("head", ignorenulls=True).over(before)))
    lines = lines.withColumn("over", F.col("base").isNotNull() & F.col("head").isNull() & F.col("text").rlike(t.ends))
    lines = lines.withColumn("done", F.coalesce(F.max("over").over(order), F.lit(False))).where("base IS NOT NULL AND NOT done").drop("over", "done")
    other = F.col("width") != F.col("base.width")
    text = F.col("text")
    opens = text.rlike(t.opens) & ~text.rlike(PAGE_LINES)
    # A head is its own place, a page of another width is set by its first row, and a row by itself.
    probe = F.when(F.col("head").isNotNull(), "").when(opens & (F.lit(t.every) | other), text).when(F.col("line") == 0, F.when(other, F.coalesce("first_row", F.lit(""))).otherwise(""))
    lines = _fitted(lines.withColumn("probe", probe), t)
    lines = lines.withColumn("starts", F.last("starts", ignorenulls=True).over(order))
    lines = lines.where(F.col("head").isNull() & ~text.rlike(t.begins) & (F.trim(text) != "") & ~text.rlike(PAGE_LINES))
    lines = lines.withColumn("row", F.sum(F.when(opens, 1).otherwise(0)).over(order)).where("row > 0")
    end = lambda i: F.coalesce(F.get("starts", i + 1)["at"], F.length("text"))
    cut = F.transform("starts", lambda s, i: F.struct(s["name"].alias("name"), F.trim(F.substring(text, s["at"] + 1, end(i) - s["at"])).alias("value")))
    rows = lines.select("path", "row", F.struct("page", "line", F.filter(cut, lambda c: c["value"] != "").alias("cells")).alias("l"))
    rows = rows.groupBy("path", F.col("row").alias("pos")).agg(F.flatten(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["cells"])).alias("cells"))

    def of(name: str) -> Column:
        return F.transform(F.filter("cells", lambda c: c["name"] == name), lambda c: c["value"]).alias(name)

    return rows.select("path", "pos", *[of(n) for n in t.headings if n not in t.unread])


def identity(value: Column) -> Column:
    """struct(id_type, id_no) of a cell that names a paper and its number."""
    paper = r"(?i)\b(MYKAD|NRIC|PASSPORT(?:\s+NUMBER)?|COMPANY\s+REGISTRATION)\b\s*(.*)"
    kind = F.upper(F.regexp_extract(value, paper, 1))
    return F.struct(F.when(F.startswith(kind, F.lit("PASSPORT")), "PASSPORT").otherwise(kind).alias("id_type"), identity_key(F.when(kind != "", F.regexp_extract(value, paper, 2)).otherwise(value)).alias("id_no"))


def nationality(value: Column) -> Column:
    """struct(nationality, race): a foreigner's country may end in a bracket, any other is one word."""
    rules = (r"(?i)^(MALAYSIA)N?\b\s*(.*)$", r"(?i)^(.+?\))\s+FOREIGNER\b\s*(.*)$", r"^(\S+)\s*(.*)$")
    out = F.struct(F.lit("").alias("nationality"), F.lit("").alias("race"))
    for r in reversed(rules):
        out = F.when(value.rlike(r), F.struct((F.upper if "MALAYSIA" in r else F.trim)(F.regexp_extract(value, r, 1)).alias("nationality"), F.trim(F.regexp_extract(value, r, 2)).alias("race"))).otherwise(out)
    return out


def directors(files: DataFrame) -> DataFrame:
    """A row a director of the table in files (path, text); none without name, number and designation, or with a heading in an address."""
    r = cells(files, DIRECTORS)
    value = lambda n: layout_value(F.col(n))
    mail = F.regexp_extract("at_work", r"(?i)[\w.+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 0)
    r = r.withColumn("i", identity(value("identity"))).withColumn("n", nationality(value("nationality"))).withColumn("at_work", value("service")).withColumn("mail", mail)
    work = F.when(F.col("mail") != "", F.substring(F.col("at_work"), F.lit(1), F.position(F.col("mail"), F.col("at_work")) - 1)).otherwise(F.col("at_work"))
    out = r.select(
        "path", "pos", value("name").alias("Name"), F.col("i.id_no").alias("IC"), F.col("i.id_type").alias("ID Type"), value("passport").alias("Passport Expiry"), F.col("n.nationality").alias("Nationality"), F.col("n.race").alias("Race"), value("gender").alias("Gender"), value("dob").alias("DOB"),
        value("designation").alias("Designation"), value("business").alias("Business Occupation"), layout_address(F.col("residential")).alias("Residential"), layout_address(F.array(work)).alias("Service Address"), F.col("mail").alias("Email"),
    )
    return out.where((F.col("Name") != "") & F.contains(F.upper("Designation"), F.lit("DIRECTOR")) & (F.col("IC") != "") & ~F.col("Residential").rlike(LEAKED) & ~F.col("`Service Address`").rlike(LEAKED))


def members(files: DataFrame) -> DataFrame:
    """A row a member of the table in files (path, text); none without name, number and shares, or with a heading in its address.

    A number of twelve digits anywhere in the row is the identity; one that lost its first
    digit to the name gets it back.  Digits among the words of the share class belong to
    the address: after its slash, else behind its last number of four or five digits.
    """
    r = cells(files, MEMBERS)
    value = lambda n: layout_value(F.col(n))
    fields = [n for n in MEMBERS.headings if n not in MEMBERS.unread]
    r = r.withColumn("whole", F.regexp_extract(F.array_join(F.concat(*[F.col(n) for n in fields]), " "), r"(?<!\d)(\d{12})(?!\d)", 1))
    r = r.withColumn("i", identity(value("identity"))).withColumn("n", nationality(value("nationality"))).withColumn("who", value("name")).withColumn("held", value("shares")).withColumn("home", layout_address(F.col("address")))
    lost = (F.col("whole") == "") & F.col("who").rlike(r"\s\d$") & F.col("i.id_no").rlike(r"^\d{11}$")
    number = F.when(F.col("whole") != "", F.col("whole")).when(lost, F.concat(F.regexp_extract("who", r"(\d)$", 1), F.col("i.id_no"))).otherwise(F.col("i.id_no"))
    paper = F.when((F.col("whole") != "") | lost, "MYKAD").otherwise(F.col("i.id_type"))
    share_class = F.trim(F.regexp_extract("held", r"^[\d,]+\s*(.*)$", 1))
    spilt = F.regexp_extract(share_class, r"\d+", 0)
    home = F.when(spilt == "", F.col("home")).when(F.col("home").rlike(r"/\s"), F.regexp_replace("home", r"^(.*?/)\s", F.concat(F.lit("$1"), spilt, F.lit(" ")))).otherwise(F.regexp_replace("home", r"^(.*\b\d{4,5})\b(.*)$", F.concat(F.lit("${1}"), spilt, F.lit("$2"))))
    kind = F.upper(share_class)
    named = F.when(F.contains(kind, F.lit("ORDINARY")), "ORDINARY SHARES").when(F.contains(kind, F.lit("FERENCE")), "PREFERENCE SHARES").otherwise(F.trim(F.regexp_replace(F.regexp_replace(share_class, r"\d+", ""), r"\s+", " ")))
    held_by = value("member_type")
    out = r.select(
        "path", "pos", F.when(F.endswith(F.upper(held_by), F.lit("INDIVIDUAL")), "INDIVIDUAL").otherwise(held_by).alias("Type"), F.when(lost, F.regexp_replace("who", r"\s\d$", "")).otherwise(F.col("who")).alias("Name"), paper.alias("ID Type"), number.alias("ID No"),
        value("passport").alias("Passport Expiry"), F.col("n.nationality").alias("Nationality"), F.col("n.race").alias("Race"), value("gender").alias("Gender"), value("dob").alias("DOB"), layout_address(F.array(home)).alias("Address"),
        F.replace(F.regexp_extract("held", r"^([\d,]+)", 1), F.lit(",")).alias("Shares"), named.alias("Share Type"), value("analysis").alias("Analysis"),
    )
    return out.where((F.col("Name") != "") & (F.col("ID No") != "") & (F.col("Shares") != "") & ~F.col("Address").rlike(LEAKED))


def registers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directors, members) of files (path, text); members without a number of their own take the person at their address that has one."""
    return directors(files), repaired_identities(members(files), "path", "pos")
