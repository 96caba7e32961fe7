"""People of a new company with where each value comes from, and whether the company is ready.

A person's value is the first one that is there, of the person's own record, of the same
person on the other roster, of its ownership form if that was in force on the day of
incorporation, and of further sources in their order.  Whatever lacks or contradicts is an
issue, and a company with any issue has no people: all or nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import clean, has_value, identity_key, nationality_adjective
from karst.functions.values import parse_date, parse_decimal
from karst.operators.people import match_people
from karst.records.companies import q
from karst.sources.tables import scratch_folder

_OWN, _MORE = ("record", "counterpart"), ("primary", "secondary")
# Where each field is looked for, source by source, and the label it is asked for by.
FIELDS = {
    "nationality": {s: ("Nationality",) for s in (*_OWN, "owner", *_MORE)},
    "race": {s: ("Race",) for s in (*_OWN, "owner", *_MORE)},
    "gender": {s: ("Gender",) for s in (*_OWN, "owner", *_MORE)},
    "date_of_birth": {s: ("DOB",) for s in (*_OWN, "owner", *_MORE)},
    "passport_expiry": {s: ("Passport Expiry",) for s in (*_OWN, *_MORE)},
    "residential_address": {"record": ("Address", "Residential Address"), "counterpart": ("Address",), "owner": ("Residential Address",)} | {s: ("Residential Address", "Address") for s in _MORE},
    "email": {s: ("Email",) for s in (*_OWN, "owner", *_MORE)},
    "phone": {s: ("Contact No",) for s in (*_OWN, "owner", *_MORE)},
    "occupation": {"record": ("Business Occupation", "Designation"), "counterpart": ("Business Occupation", "Designation"), "owner": ("Designation",)} | {s: ("Business Occupation", "Designation") for s in _MORE},
    "citizenship": {s: ("Citizenship",) for s in ("owner", *_MORE)},
}
LABELS = {
    "name": "Name", "id_type": "ID Type", "id_number": "Identification No.", "nationality": "Nationality", "race": "Race", "gender": "Gender", "date_of_birth": "Date of Birth", "residential_address": "Residential Address", "email": "Email",
    "phone": "Contact No.", "occupation": "Business Occupation", "shares": "Shares", "share_class": "Share Type",
}
CAPACITY = {"name": 80, "id_number": 40, "nationality": 40, "race": 30, "gender": 20, "residential_address": 180, "email": 100, "phone": 40, "occupation": 80}
COMPANY = {"Company Name": 100, "Reg No": 50, "S14 Incorporation Date": None, "S14 Registered Address": 180, "S14 Business Address": 180}
UPPER = ("race", "gender", "occupation")


def _cell(row: str, names: tuple[str, ...], columns: list[str]) -> Column | None:
    """The first value of a source's columns that is there; None if it has none of them."""
    found = [F.when(has_value(F.col(f"{row}.{q_(n)}").cast("string"), True), clean(F.col(f"{row}.{q_(n)}").cast("string"))) for n in names if n in columns]
    return F.coalesce(*found) if found else None


def q_(name: str) -> str:
    return f"`{name}`"


def ranked(sources: dict[str, tuple[str, list[str]]], fields: dict[str, dict[str, tuple[str, ...]]] = FIELDS) -> dict[str, Column]:
    """struct(value, source) of each field: ``sources`` has, in order, the struct column of a source and its columns."""
    out = {}
    for field, names in fields.items():
        found = F.lit(None).cast("struct<value:string,source:string>")
        for source in reversed([s for s in names if s in sources]):
            row, columns = sources[source]
            v = _cell(row, names[source], columns)
            if v is not None:
                found = F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(source).alias("source"))).otherwise(found)
        out[field] = found
    return out


def _matched(people: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """``people`` with a struct of the one row of ``other`` of the same company and number, else name."""
    own = lambda c: F.when(c != "", F.concat(F.col("company").cast("string"), F.lit("\0"), c))
    rows = other.select(own(F.col("__i")).alias("__ki"), own(F.col("__n")).alias("__kn"), F.struct(*[q(c) for c in other.columns if not c.startswith("__")]).alias(name))
    left = people.withColumns({"__ki": own(F.col("__i")), "__kn": own(F.col("__n"))})
    return match_people(left, rows, "company", "__ki", "__kn", name).drop("__ki", "__kn")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"__i": F.coalesce(identity_key(q("ID No")), F.lit("")), "__n": F.coalesce(identity_key(q("Name")), F.lit(""))})


def _issue(df: DataFrame, code: str, subject: Column) -> DataFrame:
    return df.select("company", F.lit(code).alias("code"), subject.cast("string").alias("subject"))


def people(directors: DataFrame, members: DataFrame, owners: DataFrame, more: list[DataFrame] = (), day: DataFrame | None = None) -> DataFrame:
    """A row a person of either roster: company, role, slot, its fields as struct(value, source), and what it lacks.

    All tables have company, Name and ID No and those of the columns of ``FIELDS`` they know;
    rosters have slot and ID Type, members Shares and Share Type, owners the dates and Criteria C.
    ``day`` has the company's incorporated.  A corporate member (Type or ID Type) is left
    out.  Of several rows for one person in a source none counts.
    """
    directors, members, owners = map(_keyed, (directors, members, owners))
    corporate = F.contains(F.upper(F.coalesce(F.nullif(clean(q("Type")), F.lit("")), clean(q("ID Type")), F.lit(""))), F.lit("COMPANY")) if "Type" in members.columns else F.lit(False)
    total = members.groupBy("company").agg(F.sum(F.coalesce(parse_decimal(q("Shares")), F.lit(0))).alias("__total"))
    out = []
    for role, mine, other in (("director", directors, members), ("member", members.where(~corporate), directors)):
        rows = mine.select("company", "slot", "__i", "__n", F.struct(*[q(c) for c in mine.columns if not c.startswith("__")]).alias("record"))
        rows = _matched(rows, other, "counterpart")
        rows = _matched(rows, owners, "owner")
        sources = {"record": ("record", mine.columns), "counterpart": ("counterpart", other.columns), "owner": ("owner", owners.columns)}
        for name, df in zip(_MORE, more):
            rows = _matched(rows, _keyed(df), name)
            sources[name] = (name, df.columns)
        if day is not None:
            rows = rows.join(day.select("company", "incorporated"), "company", "left")
            since, until = parse_date(F.col("owner.`Date of Becoming BO`")), parse_date(F.col("owner.`Date of Cessation`"))
            rows = rows.withColumn("owner", F.when(~F.coalesce(since > F.col("incorporated"), F.lit(False)) & ~F.coalesce(until <= F.col("incorporated"), F.lit(False)), F.col("owner")))
        else:
            rows = rows.withColumn("incorporated", F.lit(None).cast("date"))
        rows = rows.withColumns(ranked(sources))
        own = lambda n: F.struct(F.nullif(clean(F.col(f"record.{q_(n)}").cast("string")), F.lit("")).alias("value"), F.lit("record").alias("source")) if n in mine.columns else F.lit(None).cast("struct<value:string,source:string>")  # noqa: E731, B023
        rows = rows.withColumns({"name": own("Name"), "id_type": own("ID Type"), "id_number": own("ID No"), "shares": own("Shares") if role == "member" else F.lit(None).cast("struct<value:string,source:string>"), "share_class": own("Share Type") if role == "member" else F.lit(None).cast("struct<value:string,source:string>")})
        rows = rows.join(total, "company", "left").withColumn("role", F.lit(role))
        held = parse_decimal(F.col("shares.value"))
        control = has_value(F.col("owner.`Criteria C`"), True) if "Criteria C" in owners.columns else F.lit(False)
        rows = rows.withColumn("percentage", F.when((F.col("__total") > 0) & held.isNotNull(), (held * 100 / F.col("__total")).cast("decimal(18,6)"))).withColumn("control", control)
        rows = rows.withColumn("beneficial_owner", F.lit(role == "member") & (F.coalesce(F.col("percentage") >= 20, F.lit(False)) | F.col("control")))
        since = parse_date(F.col("owner.`Date of Becoming BO`")) if "Date of Becoming BO" in owners.columns else F.lit(None).cast("date")
        out.append(rows.withColumn("becoming", F.coalesce(since, F.when(F.col("beneficial_owner"), F.col("incorporated")))))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.drop("record", "counterpart", "owner", *_MORE, "__total", "__i", "__n") for r in out])
    change = lambda n, f: F.when(F.col(n).isNotNull(), F.struct(f(F.col(f"{n}.value")).alias("value"), F.col(f"{n}.source").alias("source")))
    both = both.withColumns({n: change(n, F.upper) for n in UPPER} | {n: change(n, nationality_adjective) for n in ("nationality", "citizenship")} | {n: change(n, lambda v: parse_date(v).cast("string")) for n in ("date_of_birth", "passport_expiry")})
    both = both.withColumn("citizenship", F.coalesce("citizenship", "nationality"))
    blank = lambda n: F.col(f"{n}.value").isNull()
    lacks = [F.when(blank(n) & (F.lit(n not in ("shares", "share_class")) | (F.col("role") == "member")), F.lit(label)) for n, label in LABELS.items()]
    expiry = F.when(F.contains(F.upper(F.coalesce(F.col("id_type.value"), F.lit(""))), F.lit("PASSPORT")) & blank("passport_expiry"), F.lit("Passport Expiry Date"))
    return both.withColumn("missing", F.filter(F.array(*lacks, expiry), lambda x: x.isNotNull()))


def prepare(companies: DataFrame, directors: DataFrame, members: DataFrame, owners: DataFrame, more: list[DataFrame] = ()) -> tuple[DataFrame, DataFrame]:
    """(companies with ready and issues, people of those that are ready).

    ``companies`` has company and the columns of ``COMPANY``; a company twice is
    ``source_ambiguous``.  Issues are (code, subject), sorted.  A company without a day of
    incorporation has no issues but its own: its people can't be judged.
    """
    text = lambda n: F.coalesce(clean(q(n).cast("string")), F.lit(""))
    once = companies.groupBy("company").agg(F.count(F.lit(1)).alias("__rows"), F.first(F.struct(*[q(c) for c in companies.columns if c != "company"])).alias("__c")).select("company", "__rows", "__c.*")
    once = once.withColumn("incorporated", parse_date(q("S14 Incorporation Date")))
    judged = once.where("__rows = 1 AND incorporated IS NOT NULL").select("company", "incorporated")
    of = lambda df: df.join(judged.select("company"), "company", "left_semi")
    directors, members, owners = of(directors), of(members), of(owners)
    # Written once, as issues and people both come of it.
    place, spark = scratch_folder(companies.sparkSession, "people"), companies.sparkSession
    made = people(directors, members, owners, list(more), judged)
    made.write.parquet(place)
    all_people = spark.read.schema(made.schema).parquet(place)
    found = [_issue(once.where("__rows > 1"), "source_ambiguous", F.col("__rows"))]
    single = once.where("__rows = 1")
    for label, most in COMPANY.items():
        lacks = F.col("incorporated").isNull() if label == "S14 Incorporation Date" else text(label) == ""
        found.append(_issue(single.where(lacks), "missing_company_data", F.lit(label)))
        if most:
            found.append(_issue(single.where(F.length(text(label)) > most), "field_over_capacity", F.lit(label)))
    for role, df in (("director", directors), ("member", members)):
        k = _keyed(df)
        twice = k.where("__i <> ''").groupBy("company", "__i").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(_issue(twice, "conflicting_person_data", F.concat(F.lit(f"{role} "), F.col("__i"))))
        named = k.where("__n <> ''").groupBy("company", "__n").agg(F.count_distinct("__i").alias("n")).where("n > 1")
        found.append(_issue(named, "conflicting_person_data", F.concat(F.lit(f"{role} "), F.col("__n"))))
        found.append(_issue(judged.join(df, "company", "left_anti"), f"missing_{role}s", F.lit(None)))
    one, two = (_keyed(df).select("company", "__i", "__n").distinct() for df in (directors, members))
    two = two.withColumnsRenamed({"__i": "__i2", "__n": "__n2"})
    by_number = one.join(two, (one["company"] == two["company"]) & (F.col("__i") == F.col("__i2")) & (F.col("__i") != "") & (F.col("__n") != F.col("__n2"))).select(one["company"], "__i").distinct()
    by_name = one.join(two, (one["company"] == two["company"]) & (F.col("__n") == F.col("__n2")) & (F.col("__n") != "") & (F.col("__i") != F.col("__i2"))).select(one["company"], "__n").distinct()
    found += [_issue(by_number, "conflicting_person_data", F.concat(F.lit("both "), F.col("__i"))), _issue(by_name, "conflicting_person_data", F.concat(F.lit("both "), F.col("__n")))]
    if "Type" in members.columns:
        kind = F.upper(F.coalesce(F.nullif(clean(q("Type")), F.lit("")), clean(q("ID Type")), F.lit("")))
        found.append(_issue(members.where(F.contains(kind, F.lit("COMPANY"))), "unsupported_corporate_member", q("Name")))
    shares = members.groupBy("company").agg(F.sum(F.coalesce(parse_decimal(q("Shares")), F.lit(0))).alias("s"))
    found.append(_issue(judged.join(shares, "company", "left").where("coalesce(s, 0) <= 0"), "invalid_total_shares", F.lit(None)))
    who = F.concat(F.col("role"), F.lit(" "), F.col("slot").cast("string"))
    found.append(_issue(all_people.where(F.size("missing") > 0), "missing_person_data", F.concat(who, F.lit(": "), F.array_join("missing", ", "))))
    whole = all_people.where(F.size("missing") == 0)
    over = F.filter(F.array(*[F.when(F.length(f"{n}.value") > most, F.lit(LABELS[n])) for n, most in CAPACITY.items()]), lambda x: x.isNotNull())
    found.append(_issue(whole.withColumn("over", F.explode(over)), "field_over_capacity", F.concat(who, F.lit(" "), F.col("over"))))
    issues = reduce(DataFrame.unionByName, found).groupBy("company").agg(F.array_sort(F.collect_list(F.struct("code", "subject"))).alias("issues"))
    told = once.drop("__rows").join(issues, "company", "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<code:string,subject:string>>"))).withColumn("ready", F.size("issues") == 0)
    return told, all_people.join(told.where("ready").select("company"), "company", "left_semi").drop("missing")
