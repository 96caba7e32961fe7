"""The full run: filing texts to companies, documents, events and issues.

Texts are read once.  That pass tells what each paper is and its own fields, and writes
the papers by section; the readers of a section then read its papers alone, and write
people and events once.  Everything after that works on these tables, without texts.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import person_key
from karst.functions.values import parse_date, parse_integer, source_date
from karst.records import candidates, drafts, filings, layout, parse, rosters, state, updates


class Parsed(NamedTuple):
    """papers (all, without texts), holdings, officers and events of those that were read."""

    papers: DataFrame
    holdings: DataFrame
    officers: DataFrame
    events: DataFrame


class Run(NamedTuple):
    companies: DataFrame
    documents: DataFrame
    events: DataFrame
    issues: DataFrame


def _heads(t: Column) -> dict[str, Column]:
    """What a paper says of itself, by its section."""
    by = lambda **sections: reduce(lambda out, x: F.when(F.col("section") == x[0], x[1]).otherwise(out), sections.items(), F.lit(None))
    shares = lambda field: parse_integer(parse.value(t, field))
    own = lambda n: F.nullif(F.col(f"__s14.{n}"), F.lit(""))
    return {
        "effective": by(S68=parse_date(parse.value(t, "annual_return_date")), S78=parse_date(parse.value(t, "allotment_date")), S14=parse.incorporation_date(t)),
        "total_shares": by(S68=shares("total_shares_s68"), S51=shares("total_shares_s51"), S14=shares("total_shares_s14"), S78=parse.total_shares_s78(t)).cast("long"),
        "company_name": by(S68=parse.value(t, "company_name"), S14=own("Name")),
        "registration_no": F.coalesce(by(S14=own("Reg No")), F.array_join("registrations", "/")),
        "business_address": by(S68=parse.business_address(t), S14=own("Business Address")),
        "financial_address": by(S68=parse.value(t, "financial_address"), S14=own("Registered Address")),
    }


def parse_once(files: DataFrame, folder: str) -> Parsed:
    """Reads ``files`` (folder, path, text, sha256; size and modified if there) and writes what they hold below ``folder``."""
    spark = files.sparkSession

    def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    more = [c for c in ("size", "modified") if c in files.columns]
    read = filings.read(files).join(files.select("path", *more).dropDuplicates(["path"]), "path", "left") if more else filings.read(files)
    t = F.coalesce("text", F.lit(""))
    read = read.withColumn("__s14", F.struct(*[c.alias(n) for n, c in parse.company_fields_s14(t).items()])).withColumns(_heads(t)).drop("__s14")
    papers = keep(read, "papers", "section")

    def texts(section: str) -> DataFrame:
        return papers.where((F.col("section") == section) & (F.col("status") == "VALID")).select("folder", "path", "text", "business_address", "total_shares")

    where = papers.select("path", "folder")
    at = lambda df: df.join(where, "path") if "folder" not in df.columns else df
    returns = texts("S68")
    placed = keep(candidates.repaired_identities(layout.members(returns), "path", "pos"), "layout_members")
    sums = placed.groupBy("path").agg(F.sum(parse_integer(F.col("Shares"))).alias("held"))
    fits = sums.join(returns.select("path", "total_shares"), "path").where("total_shares IS NULL OR total_shares = held").select("path")
    told = layout.directors(returns).join(returns.select("path", "business_address"), "path")
    placed_directors = keep(candidates.repaired_directors(told, placed, "path", "business_address").drop("business_address"), "layout_directors")
    run_on = keep(rosters.directors_s68(returns), "text_directors")
    count = lambda df, n: df.groupBy("path").agg(F.count(F.lit(1)).alias(n))
    better = count(placed_directors, "a").join(count(run_on, "b"), "path", "left").where("a >= coalesce(b, 0)").select("path")
    pick = lambda new, old, which: new.join(which, "path", "left_semi").unionByName(old.join(which, "path", "left_anti"), allowMissingColumns=True)

    s51 = rosters.members_s51(texts("S51"))
    members = [("S68", pick(placed, rosters.members_s68(returns), fits)), ("S51", s51), ("S78", parse.allotments(texts("S78"))), ("S14", parse.people_s14(texts("S14"), parse.MEMBERS_S14))]
    rows = [candidates.member(at(df), s).withColumn("section", F.lit(s)) for s, df in members]
    holdings = keep(reduce(DataFrame.unionByName, rows), "holdings")
    member_dates = s51.groupBy("path").agg(F.max(parse_date(F.col("Date"))).alias("member_date"))
    people = [pick(placed_directors, run_on, better), rosters.directors_s68(texts("FORM49")), parse.people_s14(texts("S14"), parse.DIRECTORS_S14)]
    officers = keep(reduce(DataFrame.unionByName, [candidates.officer(at(df)) for df in people]), "officers")
    notes = texts("S58")
    modern = filings.officer_events(notes.withColumns({"section": F.lit("S58"), "lodged": F.lit(None).cast("date")})).withColumnRenamed("event", "kind")
    new = rosters.new_directors_s58(notes).withColumns({"kind": F.lit("APPOINT"), "event_date": parse_date(F.col("Appointment Date"))})
    left = parse.cessations(notes).where("Name <> '' OR IC <> ''").withColumns({"kind": F.lit("CEASE"), "event_date": parse_date(F.col("Date of Cessation"))})
    changed = updates.changes(notes)[0].withColumn("kind", F.lit("UPDATE")).withColumnsRenamed({"name": "Name", "ic": "IC", "nationality": "Nationality", "race": "Race", "gender": "Gender", "dob": "DOB", "residential": "Residential", "service_address": "Service Address", "email": "Email", "contact_no": "Contact No"})
    events = keep(reduce(DataFrame.unionByName, [candidates.officer(at(df)) for df in (modern, new, left, changed)]), "events")
    # Registers and notifications take their date from their rows where they don't tell one.
    event_dates = events.groupBy("path").agg(F.max("event_date").alias("event_own"))
    narrow = papers.drop("text").join(member_dates, "path", "left").join(event_dates, "path", "left")
    own = F.when(F.col("section") == "S51", F.coalesce("lodged", "member_date")).when(F.col("section") == "S58", F.coalesce("event_own", "lodged")).when(F.col("section") == "FORM49", F.col("lodged")).otherwise(F.col("effective"))
    heads = filings.canonicalise(narrow.withColumn("effective", F.coalesce(own, source_date(F.col("path")))).drop("member_date", "event_own"))
    return Parsed(keep(heads, "heads"), holdings, officers, events)


def resolve(parsed: Parsed, folder: str) -> Run:
    """The four outputs of what was parsed; members and directors come with their company, in the order of their slots."""
    spark = parsed.papers.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    valid = parsed.papers.where("status = 'VALID'")
    live = lambda df: df.join(valid.select("path"), "path", "left_semi")
    holdings, officers, events = live(parsed.holdings), live(parsed.officers), live(parsed.events)
    now, totals, member_issues = state.members(valid, holdings.select("folder", "path", "id_no", "name", "shares"))
    now, totals = keep(now, "members"), keep(totals, "totals")
    leaders, leader_issues = state.directors(valid, officers, events)
    leaders = keep(leaders, "directors")
    rows, none = state.companies(valid, state.total_shares(valid, totals))
    slots = lambda df, n: df.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("slot", *[c for c in df.columns if c not in ("folder", "slot")]))).alias(n))
    companies = rows.join(slots(now, "members"), "folder", "left").join(slots(leaders, "directors"), "folder", "left")
    issues = reduce(DataFrame.unionByName, [filings.issues(parsed.papers), member_issues, leader_issues, none])
    told = holdings.join(valid.select("path", "effective"), "path").withColumns({"event_type": F.when(F.col("section") == "S78", "ALLOTMENT").otherwise("MEMBER_SNAPSHOT"), "who": F.col("id_no")})
    said = events.withColumns({"section": F.lit("S58"), "effective": F.col("event_date"), "event_type": F.col("kind"), "who": F.col("ic")})
    there = officers.join(valid.select("path", "section", "effective"), "path").withColumns({"event_type": F.lit("DIRECTOR_SNAPSHOT"), "who": F.col("ic")})

    def ledger(df: DataFrame) -> DataFrame:
        payload = F.to_json(F.struct(*[c for c in df.columns if c not in ("folder", "path", "section", "event_type", "effective", "who")]), {"ignoreNullFields": "false"})
        return df.select("folder", F.col("path").alias("source_path"), "section", "event_type", "effective", person_key(F.col("who"), F.col("name")).alias("subject_key"), F.col("name").alias("subject_name"), payload.alias("payload"))

    documents = drafts.audit_rows(parsed.papers.withColumn("registration", F.array_join("registrations", "/")), ["company_name", "registration_no", "business_address", "financial_address", "total_shares"])
    return Run(companies, documents, reduce(DataFrame.unionByName, map(ledger, (told, said, there))), issues)


def full_run(files: DataFrame, folder: str) -> Run:
    """``parse_once`` and ``resolve`` below ``folder``, which driver and executors reach and which must be new."""
    return resolve(parse_once(files, f"{folder}/parsed"), f"{folder}/resolved")


def wide(companies: DataFrame, members: int = 49, directors: int = 49) -> DataFrame:
    """``Member{n} field`` and ``Director{n} field`` columns in place of the arrays, blank where a company has fewer."""
    def columns(name: str, most: int) -> list[Column]:
        fields = [f.name for f in companies.schema[name].dataType.elementType.fields if f.name not in ("slot", "key")]
        return [F.coalesce(F.get(name, F.lit(n))[f].cast("string"), F.lit("")).alias(f"{name[:-1].title()}{n + 1} {f}") for n in range(most) for f in fields]

    return companies.select(*[c for c in companies.columns if c not in ("members", "directors")], *columns("members", members), *columns("directors", directors))
