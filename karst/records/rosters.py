"""Members and directors out of the registers and returns of sections 51, 58 and 68, as expressions.

Rows are lists of words.  What every row of a register has, numbers of shares or a date of
birth, is its anchor; words on either side of it are columns by their kind and their
distance from it, and where a name ends and an address begins is decided by the
strongest sign that a word gives.  A row without its anchor gives nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.once import once, worked_out
from karst.functions.text import clean
from karst.functions.values import parse_integer
from karst.operators.extract import section

# Words of the table's head, of streets and of firms, and countries an address may end with.
HEAD_WORDS = ("IDENTIFICATION", "SHAREHOLDERS", "NAME", "ADDRESS", "NUMBER OF", "TRANSFER", "CESSATION", "UPDATE", "PROFILE", "TOTAL", "FINAL", "SHARES", "DATE OF", "PARTICULAR", "NO OF")
STREETS = ("NO", "LOT", "UNIT", "JALAN", "LORONG", "PERSIARAN", "BANDAR", "TAMAN", "KAMPUNG", "BUKIT", "LEBUH", "DESA", "SUNGAI", "PULAU", "BATU", "MUKIM", "DAERAH", "NEGERI", "BLK", "BLOK")
FIRM_ENDS = ("BHD", "SDNBHD", "LTD", "LIMITED", "INC", "CORPORATION", "COLTD", "PLC")
FIRM_WORDS = ("SDN. BHD.", "SDN BHD", "SDN.BHD.", "BHD.", "LTD.", "PLC", "INC.", "LIMITED", "CORPORATION", "CO. LTD", "CO LTD", "COMPANY", "HOLDINGS")
COUNTRIES = ("MALAYSIA", "SINGAPORE", "TAIWAN", "INDIA", "CHINA")
AMOUNT, DAY, ISO_DAY = r"^\d[\d,]*$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{4}-\d{2}-\d{2}$"
OCCUPATIONS = ("COMPANY DIRECTOR", "DIRECTOR", "BUSINESSMAN", "MANAGER", "EMPLOYEE", "SELF EMPLOYED", "RETIRED", "HOUSEWIFE", "STUDENT", "PROFESSIONAL", "CONSULTANT", "CHARTERED SECRETARY", "NIL")
NEW_DIRECTOR = {
    "Name": r"(?i)Name\s+(.*?)(?:\n|$)", "IC": r"(?i)Identification\s+Number\s+(\d{12})", "Nationality": r"(?i)Nationality\s+([A-Z]+)", "Race": r"(?i)Race\s+([A-Z]+)", "Gender": r"(?i)Gender\s+([A-Z]+)",
    "DOB": r"(?i)Date\s+of\s+Birth\s+(\d{2}/\d{2}/\d{4})", "Appointment Date": r"(?i)Date\s+of\s+Appointment\s+(\d{2}/\d{2}/\d{4})", "Residential": r"(?is)Residential\s+Address\s+(.*?)(?:Service\s+Address|Email|\z)",
}
MEMBER_TYPES, PAPERS, SEXES = ("INDIVIDUAL", "COMPANY", "BODY CORPORATE", "NOMINEE"), ("MYKAD", "PASSPORT", "NRIC", "IDENTIFICATION CARD"), ("MALE", "FEMALE")


def _text(files: DataFrame) -> Column:
    return F.coalesce(files["text"], F.lit(""))


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _text_of(words: Column, start: Column, n: Column | None = None) -> Column:
    """``n`` words from ``start`` (from 0) as a text, or all that follow; empty where the range is."""
    many = F.size(words) - start if n is None else n
    return F.when((many > 0) & (start < F.size(words)), F.array_join(F.slice(words, start + 1, F.greatest(many, F.lit(1))), " ")).otherwise("")


def _plain(w: Column) -> Column:
    return F.regexp_replace(F.upper(w), "[^A-Z0-9]", "")


def _where(words: Column, test, after: Column | int = -1) -> Column:
    """Place (from 0) of the first word behind ``after`` that passes; null if none does."""
    at = F.transform(words, lambda w, i: F.when((i > after) & test(w), i))
    return F.array_min(F.filter(at, lambda i: i.isNotNull()))


def _parted(words: Column) -> Column:
    """struct(name, address): each word may be the first of the address, by what it is or what it follows; the strongest sign decides, of equal ones the first.

    A firm's form ends a name (4); a street (3), a postcode (2) or, at the end, a country (1) begins an address behind a name of four characters.
    """
    def parted(words: Column) -> Column:
        last = F.size(words) - 1

        def sign(w: Column, i: Column) -> Column:
            room = F.length(_text_of(words, F.lit(0), i)) >= 4
            strength = F.when((i > 0) & _plain(F.get(words, i - 1)).isin(*FIRM_ENDS), 4).when(room & _plain(w).isin(*STREETS) & (i < last), 3).when(room & w.rlike(r"\b\d{5}\b"), 2).when(room & (i == last) & _plain(w).isin(*COUNTRIES), 1).otherwise(0)
            return F.struct(strength.alias("strength"), (-i).alias("early"))

        cut = lambda best: F.when(best["strength"] > 0, -best["early"]).otherwise(F.size(words))
        at = once(F.array_max(F.transform(words, sign)), cut)
        return once(at, lambda i: F.struct(clean(_text_of(words, F.lit(0), i)).alias("name"), clean(_text_of(words, i)).alias("address")))

    return once(words, parted)


def members_s51(files: DataFrame) -> DataFrame:
    """A row a shareholder of a register of members: path, pos, IC, Name, Address, Shares, Transferred In, Transferred Out, Date, Nationality, Race and Type.

    A row's last line ends in four numbers (held, in, out, final) and, it may be, a date.
    Its identity is the first word of the first line that can be one; name and address follow it.
    """
    # A soft hyphen at a line's end joins it to the next one.
    block = F.regexp_replace(section(_text(files), r"PARTICULAR\s+OF\s+SHAREHOLDERS", (r"ANALYSIS\s+OF\s+SHAREHOLDINGS", "DECLARATION")), "­[ \t]*\n", "­")

    def line(words: Column) -> Column:
        return once(words, _line)

    def _line(words: Column) -> Column:
        n = F.size(words) - F.when(F.coalesce(F.element_at(F.when(F.size(words) > 0, words), -1).rlike(DAY), F.lit(False)), 1).otherwise(0)
        tail = F.when(n >= 4, F.slice(words, F.greatest(n - 3, F.lit(1)), F.lit(4)))
        ends = F.coalesce(F.forall(tail, lambda w: w.rlike(AMOUNT)), F.lit(False))
        kept = F.when(ends, F.when(n > 4, F.slice(words, F.lit(1), F.greatest(n - 4, F.lit(1)))).otherwise(F.array().cast("array<string>"))).otherwise(words)
        return F.struct(kept.alias("words"), F.when(ends, tail).alias("numbers"), F.when(ends & (n < F.size(words)), F.element_at(words, -1)).otherwise("").alias("day"))

    rows = worked_out(files.select("path", block.alias("b")), lines=F.transform(F.split("b", "\n"), lambda x: line(_words(x))))
    rows = worked_out(rows, ends=F.filter(F.transform("lines", lambda x, i: F.when(x["numbers"].isNotNull(), i + 1)), lambda i: i.isNotNull()))
    first = lambda j: F.when(j > 0, F.get("ends", j - 1)).otherwise(0)
    parts = F.transform("ends", lambda e, j: F.struct(F.filter(F.transform(F.slice("lines", first(j) + 1, e - first(j)), lambda x: x["words"]), lambda w: F.size(w) > 0).alias("lines"), F.get("lines", e - 1).alias("last")))
    rows = rows.select("path", F.posexplode(parts).alias("pos", "e")).where(F.length(F.array_join(F.flatten("e.lines"), " ")) >= 20)

    def is_identity(words: Column) -> Column:
        text, one = F.upper(F.array_join(words, " ")), F.regexp_replace(F.get(words, F.lit(0)), "­", "")
        head = F.exists(F.array(*[F.lit(w) for w in HEAD_WORDS]), lambda h: F.contains(text, h))
        shape = F.when(F.size(words) == 1, one.rlike(r"^(?=.*\d)[0-9A-Z-]{4,30}$")).otherwise(one.rlike(r"^(?=.*\d)[0-9A-Za-z-]{4,20}$"))
        return shape & ~head & ~((F.length(text) < 8) & text.rlike(r"^[\d\s.,#/()-]+$"))

    rows = worked_out(rows, at=_where(F.col("e.lines"), is_identity)).where("at is not null")
    rows = worked_out(rows, own=F.get("e.lines", F.col("at")))
    rows = worked_out(rows, words=F.concat(F.slice("own", F.lit(2), F.size("own")), F.flatten(F.slice("e.lines", F.col("at") + 2, F.size("e.lines"))))).where("size(words) > 0")
    rows = worked_out(rows, p=_parted(F.col("words")))
    number = lambda i: parse_integer(F.get("e.last.numbers", F.lit(i)))
    firm = F.exists(F.array(*[F.lit(w) for w in FIRM_WORDS]), lambda w: F.contains(F.upper("p.name"), w))
    return rows.select(
        "path", "pos", F.regexp_replace(F.get("own", F.lit(0)), "­", "").alias("IC"), F.col("p.name").alias("Name"), F.col("p.address").alias("Address"), number(3).alias("Shares"), number(1).alias("Transferred In"), number(2).alias("Transferred Out"), F.col("e.last.day").alias("Date"),
        F.when(F.contains(F.upper("p.address"), F.lit("MALAYSIA")), "MALAYSIA").otherwise("").alias("Nationality"), F.lit("").alias("Race"), F.when(firm, "COMPANY").otherwise("INDIVIDUAL").alias("Type"),
    )


def new_directors_s58(files: DataFrame) -> DataFrame:
    """path and the fields of the new director of a section-58 notification; none without a name."""
    block = F.regexp_extract(_text(files), r"(?is)SECTION\s+[BC]\s*:\s*NEW\s+DIRECTOR\s+(.*?)(?:SECTION|PARTICULARS\s+OF\s+LODGER)", 1)
    return files.select("path", block.alias("b")).select("path", *[clean(F.regexp_extract("b", p, 1)).alias(n) for n, p in NEW_DIRECTOR.items()]).where("Name <> ''")


def _through(words: Column, start: Column, land: str) -> Column:
    """Place of the first ``land`` at or behind ``start``."""
    return _where(words, lambda w: _plain(w) == land, start - 1)


def _director(rows: DataFrame, number: str) -> DataFrame:
    """Directors of row texts ``r``, as words: a name, DIRECTOR, a number, then MALAYSIA, race, sex and the anchor, a date of birth, and two addresses."""
    w = F.col("w")
    rows = worked_out(rows, w=_words(F.col("r")))
    rows = worked_out(rows, born=_where(w, lambda x: x.rlike(ISO_DAY)), post=_where(w, lambda x: _plain(x) == "DIRECTOR")).where("born >= 3 and post > 0")
    rows = worked_out(rows, no=_where(w, lambda x: x.rlike(number), F.col("post")))
    rows = rows.where((F.col("no") < F.col("born")) & F.upper(F.get("w", F.col("born") - 1)).isin(*SEXES) & (F.upper(F.get("w", F.col("born") - 3)) == "MALAYSIA"))
    rows = worked_out(rows, home=F.coalesce(_through(w, F.col("born") + 1, "MALAYSIA"), _through(w, F.col("born") + 1, "INDIA")))
    # What a director does stands behind the second address.
    rows = worked_out(rows, rest=_words(F.when(F.col("home").isNotNull(), _text_of(w, F.col("home") + 1)).otherwise("")))
    rows = worked_out(rows, work=_through(F.col("rest"), F.lit(0), "MALAYSIA"))
    before = F.get(F.split(F.array_join("rest", " "), rf"(?i)\b(?:{'|'.join(OCCUPATIONS)})\b"), F.lit(0))
    mail = F.regexp_extract(F.regexp_replace(before, r"\s+", ""), r"(?i)([A-Z0-9_.+-]+@[A-Z0-9.-]+\.[A-Z]{2,})", 1)
    return rows.select(
        "path", "pos", clean(_text_of(w, F.lit(0), F.col("post"))).alias("Name"), F.regexp_extract(F.get("w", F.col("no")), rf"({number})", 1).alias("IC"), F.lit("MALAYSIA").alias("Nationality"), F.get("w", F.col("born") - 2).alias("Race"), F.get("w", F.col("born") - 1).alias("Gender"), F.get("w", F.col("born")).alias("DOB"),
        clean(F.when(F.col("home").isNotNull(), _text_of(w, F.col("born") + 1, F.col("home") - F.col("born"))).otherwise("")).alias("Residential"), clean(F.when(F.col("work").isNotNull(), _text_of(F.col("rest"), F.lit(0), F.col("work") + 1)).otherwise(mail)).alias("Service Address"),
    )


def directors_s68(files: DataFrame) -> DataFrame:
    """A row a director of an annual return: path, pos, Name, IC, Nationality, Race, Gender, DOB, Residential and Service Address.

    Rows of the directors' table begin with their number (0001 and on).  A text whose table
    gives none is read as a notification: any four-digit number begins a row, the identity
    has twelve digits, and there is no service address.
    """
    t = _text(files)
    table = section(t, r"Particulars\s+of\s+Directors", (r"Particulars\s+of\s+Managers",))
    own = t.rlike(r"(?is)Particulars\s+of\s+Directors.*?Particulars\s+of\s+Managers")
    first = files.where(own).select("path", F.posexplode(F.split(table, r"\b000\d\b")).alias("pos", "r")).withColumn("r", clean(F.col("r")))
    first = _director(first, r"\b\d+\b")
    other = files.join(first.select(F.col("path").alias("__p")).distinct(), F.col("path") == F.col("__p"), "left_anti")
    other = other.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\b\d{4}\b(?!-)")).alias("pos", "r")).withColumn("r", clean(F.col("r")))
    return first.unionByName(_director(other, r"\d{12}").withColumn("Service Address", F.lit("")))


def members_s68(files: DataFrame) -> DataFrame:
    """A row a member of an annual return's section E: path, pos, Type, Name, ID Type, ID No, Nationality, Race, Gender, DOB, Address, Shares, Share Type and Analysis.

    A row begins with two four-digit numbers; its date of birth is the anchor, and rows
    without one give nothing.  Before it stand type, name, paper, number, nationality, race and
    sex, behind it an address that ends in MALAYSIA, the number and class of shares, and the rest.
    """
    block = F.regexp_extract(_text(files), r"(?is)(SECTION\s?E\b.*?)(?=SECTION\s?F\b|\z)", 1)
    rows = files.select("path", F.posexplode(F.split(block, r"\n(?=\d{4}\s+\d{4}\s)")).alias("pos", "r")).where("pos > 0")
    rows = worked_out(rows, every=_words(clean(F.get(F.split("r", r"(?i)TOTAL NUMBER OF SHARES"), F.lit(0)))))
    rows = worked_out(rows, w=F.slice("every", F.lit(3), F.size("every")))
    w = F.col("w")
    rows = worked_out(rows, born=_where(w, lambda x: x.rlike(DAY))).where((F.col("born") >= 0) & (F.length(F.array_join("w", " ")) >= 30))
    named = lambda names, i: reduce(lambda out, n: F.when(F.upper(_text_of(w, i, F.lit(len(n.split())))) == n, F.struct(F.lit(n).alias("name"), F.lit(len(n.split())).alias("words"))).otherwise(out), names, F.lit(None).cast("struct<name:string,words:int>"))
    starts = F.transform(w, lambda x, i: F.when((i < F.col("born")) & named(PAPERS, i).isNotNull(), i))
    rows = worked_out(rows, kind=named(MEMBER_TYPES, F.lit(0)), at=F.array_min(F.filter(starts, lambda i: i.isNotNull())), sex=_where(w, lambda x: F.upper(x).isin(*SEXES)), lands=_through(w, F.col("born") + 1, "MALAYSIA"))
    rows = worked_out(rows.withColumn("sex", F.when(F.col("sex") < F.col("born"), F.col("sex"))), paper=F.when(F.col("at").isNotNull(), named(PAPERS, F.col("at"))))
    # Nationality and race are the last two words between the number, or the row's start, and the sex.
    left = F.coalesce(F.col("at") + F.col("paper.words") + 1, F.lit(0))
    rows = rows.withColumn("n", F.coalesce("sex", "born") - left).withColumn("to", F.coalesce("sex", "born"))
    rows = worked_out(rows, tail=_words(F.regexp_replace(_text_of(w, F.coalesce(F.col("lands"), F.col("born")) + 1), r"(?<=\d)\s+(?=\d)", "")))
    tail = F.col("tail")
    rows = worked_out(rows, held=_where(tail, lambda x: x.rlike(AMOUNT)))
    rows = worked_out(rows, kinds=_where(tail, lambda x: _plain(x).isin("SHARE", "SHARES"), F.col("held")))
    whole = F.col("kinds").isNotNull() & (F.col("kinds") + 1 < F.size("tail"))
    return rows.select(
        "path", "pos", F.coalesce("kind.name", F.lit("")).alias("Type"), F.when(F.col("kind").isNotNull() & F.col("paper").isNotNull(), clean(_text_of(w, F.col("kind.words"), F.col("at") - F.col("kind.words")))).otherwise("").alias("Name"),
        F.coalesce("paper.name", F.lit("")).alias("ID Type"), F.coalesce(F.get("w", F.col("at") + F.col("paper.words")), F.lit("")).alias("ID No"), F.when(F.col("n") >= 2, F.get("w", F.col("to") - 2)).when(F.col("n") == 1, F.get("w", F.col("to") - 1)).otherwise("").alias("Nationality"),
        F.when(F.col("n") >= 2, F.get("w", F.col("to") - 1)).otherwise("").alias("Race"), F.coalesce(F.upper(F.get("w", F.col("sex"))), F.lit("")).alias("Gender"), F.get("w", F.col("born")).alias("DOB"),
        clean(F.regexp_replace(F.when(F.col("lands").isNotNull(), _text_of(w, F.col("born") + 1, F.col("lands") - F.col("born"))).otherwise(""), r"(?<=\d)\s+(?=\d)", "")).alias("Address"),
        F.when(whole, parse_integer(F.get("tail", F.col("held")))).alias("Shares"), F.when(whole, _text_of(tail, F.col("held") + 1, F.col("kinds") - F.col("held"))).otherwise("").alias("Share Type"), F.when(whole, clean(_text_of(tail, F.col("kinds") + 1))).otherwise("").alias("Analysis"),
    )
