"""Files that may tell a company's state: what their names say, which of several counts, and people put right by what agrees with them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions.text import by_rules, clean, identity_key, name_key, registration_state
from karst.functions.values import parse_date, parse_integer, similarity, source_date
from karst.operators.extract import first_rule
from karst.operators.latest import pick

# Sections by file name, folders that are preferred (best first), and what page texts get wrong.
NAME_SECTIONS = {
    "S51": r"(?:section|sec)[\s_-]*51(?!\d)|register[\s_-]*of[\s_-]*members?|\brom\b",
    "S58": r"(?:section|sec)[\s_-]*58(?!\d)|form[\s_-]*49(?!\d)",
    "S78": r"(?:section|sec)[\s_-]*78(?!\d)|form[\s_-]*24(?!\d)",
    "S68": r"(?:section|sec)[\s_-]*68(?!\d)|annual[\s_-]*return|\bar1\b",
    "S14": r"(?:section|sec)[\s_-]*14(?!\d)|super[\s_-]*form",
}
FOLDERS = {"S14": ("FORM", "STATUTORYAUDIT"), "EBOS": ("EBOS", "BO")}
BROKEN_WORDS = {"GEORGETOW N": "GEORGETOWN", "CONDOMINI UM": "CONDOMINIUM", "ENTREPRENE URS": "ENTREPRENEURS", "W. P.": "W.P."}
BROKEN_PLACES = {"CASAIDAMAN": "CASA IDAMAN", "DESAUNIVERSITI": "DESA UNIVERSITI", "GEORGETOWNPULAU": "GEORGETOWN PULAU", "GELUGORPULAU": "GELUGOR PULAU", "HAMBIR": "GAMBIR", "PULAU INANG": "PULAU PINANG", "ULAU INANG": "PULAU PINANG"}
PERSON_FIELDS = ("Type", "Name", "ID Type", "ID No", "Nationality", "Race", "Gender", "DOB")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def section_of_name(path: Column) -> Column:
    """The section that the file's own name tells; folders above it tell nothing."""
    return first_rule(F.lower(file_name(path)), NAME_SECTIONS, "")


def is_section14_name(name: Column) -> Column:
    return F.lower(name).rlike(r"(?:section|sec)\s*14\b|superform 14")


def is_receipt(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(r"receipt|(?:^|[^a-z0-9])or[_ -]?xb")


def revision(path: Column) -> Column:
    """The highest (R n) of a file's name, 0 without one."""
    found = F.regexp_extract_all(F.regexp_replace(file_name(path), r"\.[^.]*$", ""), F.lit(r"(?i)(?:\(|\b)R\s*(\d+)(?:\)|\b)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.try_cast("int"))), F.lit(0))


def submission_rank(number: Column) -> Column:
    """The number that a submission's name ends with, 0 without one."""
    return F.coalesce(F.regexp_extract(number, r"(\d+)$", 1).try_cast("long"), F.lit(0))


def folder_score(path: Column, family: str) -> Column:
    """2 for a path through the family's own folder, 1 for its second one, else 0."""
    parts = F.transform(F.split(path, r"[/\\]"), lambda p: F.regexp_replace(F.upper(p), "[^A-Z0-9]", ""))
    best, second = FOLDERS[family]
    return F.when(F.array_contains(parts, best), 2).when(F.array_contains(parts, second), 1).otherwise(0)


def form_date(text: Column) -> Column:
    """The later of a section-14 form's dates of application and incorporation."""
    day = lambda label: parse_date(F.regexp_extract(text, rf"(?i){label}\s*:?[ \t]*(\d{{2}}/\d{{2}}/\d{{4}})", 1))
    return F.greatest(day("Date of Application"), day("Incorporation Date"))


def owner_form_date(text: Column, path: Column) -> Column:
    """An ownership form's date: received, else applied for, else eight digits of the file's name, else none."""
    received, applied = (parse_date(F.regexp_extract(text, p, 1)) for p in (r"Date & Time Received\s+(\d{2}/\d{2}/\d{4})", r"(?i)DATE\s+OF\s+APPLICATION\s+(\d{2}/\d{2}/\d{4})"))
    return F.coalesce(received, applied, F.try_to_date(F.regexp_extract(file_name(path), r"(\d{8})", 1), "yyyyMMdd"))


def candidates(files: DataFrame, family: str, registration: Column) -> DataFrame:
    """``files`` (folder, path, text, sha256, modified) as candidates of a family, one of each content and folder, with what they are ranked by.

    Those of another registration number than ``registration`` go.
    """
    t = F.coalesce("text", F.lit(""))
    told = form_date(t) if family == "S14" else owner_form_date(t, F.col("path"))
    number = F.regexp_extract(t, r"(?i)Submission\s+Number\s+(\S+)", 1)
    rows = files.withColumns({
        "document_date": F.coalesce(told, source_date(file_name(F.col("path"))), F.to_date("modified")),
        "match": registration_state(F.regexp_extract(t, r"(?i)(?:Registration|Company)\s*No\.?\s*:?\s*([^\n]+)", 1), registration),
        "order": revision(F.col("path")).cast("long") if family == "S14" else submission_rank(number),
        "score": folder_score(F.col("path"), family),
    }).where("match > 0")
    return pick(rows, ["folder", "sha256"], _order())


def _order() -> list[Column]:
    return [F.desc("document_date"), F.desc("match"), F.desc("order"), F.desc("score"), F.desc("modified"), F.desc(F.lower("path"))]


def latest(rows: DataFrame) -> DataFrame:
    """Of each folder the candidate that counts: by date, number, revision or submission, folder, time of change and path."""
    return pick(rows, ["folder"], _order())


def best_form(files: DataFrame) -> DataFrame:
    """Of each folder the section-14 file that is read if several are: the smallest by (kind, size, path)."""
    return pick(files, ["folder"], [F.asc("kind"), F.asc("size"), F.asc("path")])


def suggestions(events: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """key and values: the distinct values of each key as they first come by ``order``; values that read alike are one."""
    rows = events.where(F.trim(value) != "").withColumn("__k", name_key(F.col(value)))
    first = pick(rows, [key, "__k"], order)
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return first.withColumn("__n", n).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.trim(value).alias("v")))), lambda x: x["v"]).alias("values"))


def join_glyphs(c: Column) -> Column:
    """Runs of single letters and digits become one word."""
    return F.regexp_replace(F.trim(c), r"(?i)(?<=(?<!\S)[A-Z0-9])\s+(?=[A-Z0-9](?!\S))", "")


#: How the pieces of a cell become its text, and those of an address: (pattern, replacement), in this order.
CELL_RULES = ((r"\s+", " "), *((f"(?i){re.escape(a)}", b) for a, b in BROKEN_WORDS.items()))
ADDRESS_RULES = (
    (r"(?is)\b(?:Company\s+No\s*:|Page\s+\d+\s+of\s+\d+|DIRECTOR\b).*$", ""),
    (r"^[ ,]+|[ ,]+$", ""),
    (r"(?<=\d)(?=[A-Z])|(?<=\b\d)(?=\d{5}\b)", " "),
    *((f"(?i){re.escape(a)}", b) for a, b in BROKEN_PLACES.items()),
    (r"(?i)\bALAYSIA\b", "MALAYSIA"),
    (r"\s+(?=,|\s)", ""),
)


def layout_value(parts: Column) -> Column:
    """The pieces of a table's cell as one text."""
    return by_rules(join_glyphs(F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), " ")), CELL_RULES)


def layout_address(parts: Column) -> Column:
    """The pieces of an address: cut at a page's foot, blanks put back between numbers and words."""
    return by_rules(layout_value(parts), ADDRESS_RULES)


def repaired_identities(members: DataFrame, key: str, ordinal: str) -> DataFrame:
    """``members`` whose number is not one of twelve digits take the person of the last row at their address that has one.

    One row an address is joined back, so no row is repeated.
    """
    good = identity_key(F.col("ID No")).rlike(r"^\d{12}$")
    at = clean(F.coalesce("Address", F.lit("")))
    fields = [c for c in PERSON_FIELDS if c in members.columns]
    donors = members.where(good & (at != "")).groupBy(F.col(key).alias("__k"), at.alias("__a")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in fields]), ordinal).alias("__d"))
    out = members.join(donors, (F.col(key) == F.col("__k")) & (at == F.col("__a")), "left")
    swap = ~F.coalesce(good, F.lit(False)) & F.col("__d").isNotNull()
    return out.select(*[F.when(swap, F.col(f"__d.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in members.columns])


def repaired_directors(directors: DataFrame, members: DataFrame, key: str, business: str) -> DataFrame:
    """``directors`` with the name and address of the member of their number, and the company's address.

    A member's name counts if it is three characters longer, its address if the director's
    names no country or is much like it (0.65), and the company's address likewise (0.82).
    """
    one = members.groupBy(F.col(key).alias("__k"), identity_key(F.col("ID No")).alias("__i")).agg(F.max(F.struct(F.length("Address"), "Address", "Name")).alias("m")).where("__i <> ''")
    rows = directors.join(one, (F.col(key) == F.col("__k")) & (identity_key(F.col("IC")) == F.col("__i")), "left")
    home, work = F.coalesce("Residential", F.lit("")), F.coalesce("Service Address", F.lit(""))
    rows = rows.withColumn("__h", similarity(clean(home), clean(F.coalesce("m.Address", F.lit(""))))).withColumn("__w", similarity(clean(work), clean(F.coalesce(business, F.lit("")))))
    abroad = lambda c: ~F.contains(F.upper(c), F.lit("MALAYSIA"))
    new = {
        "Name": F.when(F.length("m.Name") >= F.length("Name") + 3, F.col("m.Name")).otherwise(F.col("Name")),
        "Residential": F.when((F.col("m.Address") != "") & (abroad(home) | (F.col("__h") >= 0.65)), F.col("m.Address")).otherwise(F.col("Residential")),
        "Service Address": F.when((F.trim(business) != "") & (abroad(work) | (F.col("__w") >= 0.82)), F.col(business)).otherwise(F.col("Service Address")),
    }
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in directors.columns])


#: Pairs of a person and an event of one key up to which they meet in one task.
PAIRS = 1_000_000


def _together(p: DataFrame, e: DataFrame, pk: str, ek: str) -> DataFrame:
    """``p`` and ``e`` where the keys are equal; people of a key with very many pairs are dealt over several groups, each with all events of the key."""
    count = lambda df, k, n: df.groupBy(F.col(k).alias("__k")).agg(F.count(F.lit(1)).alias(n))
    # More groups than people of a key would stay empty.
    groups = F.least(F.ceil(F.col("__p") * F.col("__e") / PAIRS), F.col("__p")).cast("int")
    heavy = count(p, pk, "__p").join(count(e, ek, "__e"), "__k").select("__k", groups.alias("__n")).where("__n > 1")
    dealt = p.join(heavy, F.col(pk) == F.col("__k"), "left").withColumn("__g", F.pmod(F.xxhash64("person"), F.coalesce("__n", F.lit(1))).cast("int")).drop("__k", "__n")
    every = e.join(heavy, F.col(ek) == F.col("__k"), "left").withColumn("__h", F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))).drop("__k", "__n")
    return dealt.join(every, (F.col(pk) == F.col(ek)) & (F.col("__g") == F.col("__h"))).drop("__g", "__h")


def person_events(people: DataFrame, events: DataFrame, key: str, identity: str, name: str) -> DataFrame:
    """Rows of ``events`` for each of ``people``: by number if both have one, by name if the event has none, or if the person has none and one number alone goes by the name."""
    p = people.select(F.col(key).alias("person"), identity_key(F.coalesce(identity, F.lit(""))).alias("pi"), name_key(F.coalesce(name, F.lit(""))).alias("pn"))
    e = events.withColumn("ei", identity_key(F.coalesce(identity, F.lit("")))).withColumn("en", name_key(F.coalesce(name, F.lit(""))))
    by_number = _together(p.where("pi <> ''"), e.where("ei <> ''"), "pi", "ei")
    lone = e.where("en <> ''").groupBy(F.col("en").alias("n")).agg(F.count_distinct(F.nullif("ei", F.lit(""))).alias("c")).where("c <= 1").drop("c")
    # People with a number and people without meet other events by name.
    named = e.where("en <> ''")
    numbered = _together(p.where("pn <> '' and pi <> ''"), named.where("ei = ''"), "pn", "en")
    others = _together(p.where("pn <> '' and pi = ''"), named.join(lone, F.col("en") == F.col("n"), "left_semi"), "pn", "en")
    return by_number.unionByName(numbered).unionByName(others).drop("pi", "pn", "ei", "en")


def member(rows: DataFrame, section: str) -> DataFrame:
    """Rows of any register in one shape: folder, path, type, name, id_type, id_no, address, shares and share_type.

    A register of members (S51) has its number as IC, and twelve digits are a MYKAD; what a
    row doesn't tell of type and paper follows from the number and the name.
    """
    c = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in rows.columns], F.lit(""))
    number = identity_key(c("IC", "ID No") if section == "S51" else c("ID No", "IC"))
    firm = F.concat(F.lit(" "), F.upper(c("Name"))).rlike(r" SDN| BHD| LTD| LIMITED| CORPORATION| PLC")
    kind = F.coalesce(F.nullif(c("Type"), F.lit("")), F.when(firm, "COMPANY").otherwise("INDIVIDUAL"))
    twelve = number.rlike(r"^\d{12}$")
    inferred = F.when(firm, "REGISTRATION NO").when(twelve, "MYKAD").otherwise("PASSPORT")
    paper = F.when(twelve, F.lit("MYKAD")).otherwise(inferred) if section == "S51" else F.coalesce(F.nullif(c("ID Type"), F.lit("")), inferred)
    share = F.coalesce(F.nullif(c("Share Type"), F.lit("")), F.lit("ORDINARY SHARES" if section == "S51" else ""))
    keep = [x for x in ("folder", "path") if x in rows.columns]
    return rows.select(*keep, kind.alias("type"), clean(c("Name")).alias("name"), paper.alias("id_type"), number.alias("id_no"), clean(c("Address")).alias("address"), F.coalesce(parse_integer(c("Shares")), F.lit(0)).alias("shares"), share.alias("share_type"))


def officer(rows: DataFrame) -> DataFrame:
    """Directors of any filing in one shape; a field goes by several names, and dates are ISO where they can be read."""
    c = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in rows.columns], F.lit(""))
    day = lambda x: F.coalesce(F.date_format(parse_date(x), "yyyy-MM-dd"), clean(x))
    fields = {
        "name": clean(c("Name")), "ic": identity_key(c("IC", "ID No", "Identification Number")), "id_type": c("ID Type", "Identification Type"), "dob": day(c("DOB", "Date of Birth")), "nationality": c("Nationality"), "race": c("Race"), "gender": c("Gender"),
        "residential": clean(c("Residential", "Residential Address")), "service_address": clean(c("Service Address")), "email": c("Email", "Email Address"), "contact_no": c("Contact No", "Phone Number", "Mobile Phone No"), "appointment_date": day(c("Appointment Date")),
    }
    keep = [x for x in ("folder", "path", "kind", "event_date") if x in rows.columns]
    return rows.select(*keep, *[x.alias(n) for n, x in fields.items()])
