"""The state that a folder's filings lead to: its members, its directors, its shares, and its row.

``filings`` are records that count: folder, path, section, effective (date), total_shares,
quality, reference, lodged.  ``holdings`` are the people of their registers, returns and
allotments (folder, path, id_no, name, shares), ``officers`` the directors of profiles and
``events`` what notifications say of directors.

Members are relational: the last validated snapshot, and the allotments after it, summed.
Directors depend on the order of events, so a stream of rows sorted by folder and time is
folded, with no more in memory than one folder's current directors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.functions.text import clean, person_key
from karst.operators.lookup import small
from karst.records.filings import section_rank
from karst.sources.tables import scratch_folder

# The sections that tell all members, all directors, and a company's profile.
MEMBER_SNAPSHOTS, DIRECTOR_SNAPSHOTS, PROFILES = ("S14", "S68", "S51"), ("S14", "S68", "FORM49"), ("S14", "S68")
TOTALS = ("S14", "S51", "S68", "S78")
OFFICER_KINDS = ("APPOINT", "UPDATE", "CEASE")
OFFICER_FIELDS = ("name", "ic", "nationality", "race", "gender", "dob", "residential", "service_address", "appointment_date")


def rank(precedence: bool = True) -> Column:
    """What filings are ordered by: effective date, section (where asked), quality, reference, path."""
    section = [section_rank(F.col("section")).alias("s")] if precedence else []
    return F.struct(F.col("effective"), *section, F.coalesce("quality", F.lit(0)).alias("q"), F.coalesce("reference", F.lit("")).alias("r"), F.col("path"))


def _issue(df: DataFrame, code: str, severity: str = "CRITICAL") -> DataFrame:
    return df.select("folder", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("path").alias("source_path"), "section", F.col("effective").alias("effective_date"))


def _kept(spark: SparkSession, what: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes tables below one scratch folder and reads them back."""
    place = scratch_folder(spark, what)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return spark.read.schema(df.schema).parquet(f"{place}/{name}")

    return keep


def _people(filings: DataFrame, holdings: DataFrame) -> DataFrame:
    """One row a person of a dated filing that tells members, its shares summed."""
    key = person_key(F.col("id_no"), F.col("name"))
    rows = holdings.select("folder", "path", key.alias("key"), clean(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("shares", F.lit(0)).cast("long").alias("shares"))
    # Dealt by filing, so that neither the sums nor the join shuffle again.
    rows = rows.repartition("folder", "path").groupBy("folder", "path", "key").agg(F.max("name").alias("name"), F.sum("shares").alias("shares"))
    filings = filings.where(F.col("section").isin(*MEMBER_SNAPSHOTS, "S78") & F.col("effective").isNotNull())
    return rows.join(filings.select("folder", "path", "section", "effective", "total_shares", "quality", "reference"), ["folder", "path"])


def snapshots(filings: DataFrame, holdings: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Member snapshots with ``fault``: null, or why it doesn't count.

    A snapshot must not be negative, must have members if it has shares, and its members'
    shares must be its total where it tells one.  Of one day and section all that differ
    (by total or by any holding) are in conflict.
    """
    people = (_people(filings, holdings) if people is None else people).where(F.col("section").isin(*MEMBER_SNAPSHOTS) & F.col("effective").isNotNull())
    live = F.col("shares") > 0
    one = people.groupBy("folder", "path", "section", "effective", "total_shares", "quality", "reference").agg(
        F.count_if(live).alias("active"), F.sum(F.when(live, F.col("shares"))).alias("held"), F.min("shares").alias("least"),
        F.sum(F.when(live, F.xxhash64("key", "shares").cast("decimal(38,0)"))).alias("mark"),
    )
    total = F.col("total_shares")
    wrong = (total < 0) | (F.col("least") < 0) | ((total > 0) & (F.col("active") == 0)) | ((F.col("active") > 0) & (total != F.col("held")))
    one = one.withColumn("fault", F.when(F.coalesce(wrong, F.lit(False)), "INVALID_MEMBER_SNAPSHOT"))
    day = Window.partitionBy("folder", "effective", "section")
    sound = lambda c: F.when(F.col("fault").isNull(), c)
    differ = lambda c: F.min(sound(c)).over(day) != F.max(sound(c)).over(day)
    clash = differ(F.coalesce("total_shares", F.lit(-1))) | differ(F.coalesce("mark", F.lit(0))) | differ(F.col("active"))
    one = one.withColumn("clash", clash)
    return one.withColumn("fault", F.coalesce("fault", F.when(F.col("clash"), "SAME_DATE_MEMBER_SNAPSHOT_CONFLICT"))).drop("clash", "mark")


def members(filings: DataFrame, holdings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current members, totals, issues).

    Members: folder, key, name, shares, slot; more shares first, then name.  The last
    validated snapshot counts, and allotments dated after it.  An allottee whose number is
    not known is the one holder of that name, if there is one; of several or none, a new
    holder.  Totals: folder, snapshot (path), member_total: the snapshot's total with later
    allotments, of which the last one that tells a total decides.
    """
    # People of filings and what became of snapshots are written once: six things are told from them.
    keep = _kept(filings.sparkSession, "members")
    people = keep(_people(filings, holdings), "people")
    seen = keep(snapshots(filings, holdings, people), "snapshots")
    base = seen.where("fault is null").groupBy("folder").agg(F.max(rank()).alias("top")).select("folder", F.col("top.path").alias("snapshot"), F.col("top.effective").alias("since"))
    base = small(keep(base, "base"))
    held = people.where("shares > 0 and key <> ''").join(base.select("folder", F.col("snapshot").alias("path")), ["folder", "path"]).select("folder", "key", "name", "shares")
    later = filings.where("section = 'S78' and effective is not null").join(base, "folder", "left").where("since is null or effective > since").drop("snapshot", "since")
    rows = people.where("section = 'S78' and effective is not null").join(base, "folder", "left").where("since is null or effective > since").drop("snapshot", "since")
    order = rank(False)
    rows = rows.withColumn("at", order)
    # Whose shares they are depends on folder, number and name alone, so allotments are summed by these before they meet holders.
    # Names: of one holder the holder, of none the first allottee of the name.
    known = held.where("name <> ''").groupBy("folder", "name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("holder"))
    given = keep(rows.where("key <> ''").groupBy("folder", "key", "name").agg(F.min("at").alias("at"), F.sum("shares").alias("shares")), "given")
    first = given.groupBy("folder", "name").agg(F.min_by("key", F.struct("at", "key")).alias("first"))
    given = given.join(held.select("folder", "key", F.lit(True).alias("there")), ["folder", "key"], "left")
    given = given.join(known, ["folder", "name"], "left").join(first, ["folder", "name"], "left")
    own = F.when(F.col("there") | (F.col("name") == ""), F.col("key")).when(F.col("n") == 1, F.col("holder")).when(F.col("n").isNull(), F.col("first")).otherwise(F.col("key"))
    given = given.withColumn("own", own)
    now = held.unionByName(given.select("folder", F.col("own").alias("key"), "name", "shares")).groupBy("folder", "key").agg(F.max("name").alias("name"), F.sum("shares").alias("shares")).where("shares > 0")
    now = now.withColumn("slot", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("shares"), "name", "key")))
    # Totals: each allotment that was read adds its shares, unless a later one tells the sum.
    steps = rows.groupBy("folder", "path", "total_shares", "at").agg(F.sum("shares").alias("s"))
    told = steps.where("total_shares is not null").groupBy("folder").agg(F.max("at").alias("told"), F.max_by("total_shares", "at").alias("explicit"))
    added = steps.join(told, "folder", "left").groupBy("folder").agg(F.first("explicit").alias("explicit"), F.coalesce(F.sum(F.when(F.col("told").isNull() | (F.col("at") > F.col("told")), F.col("s"))), F.lit(0)).alias("more"))
    start = base.join(seen.select("path", F.col("total_shares").alias("start")), F.col("path") == F.col("snapshot"), "left").select("folder", "snapshot", "start")
    totals = start.join(added, "folder", "full").select("folder", "snapshot", (F.coalesce("explicit", "start") + F.coalesce("more", F.lit(0))).alias("member_total"))
    sums = now.groupBy("folder").agg(F.sum("shares").alias("s"))
    last = later.groupBy("folder").agg(F.max_by(F.struct("path", "section", "effective"), order).alias("last"))
    off = totals.join(sums, "folder").where("member_total <> s").join(last, "folder", "left").join(filings.select(F.col("path").alias("snapshot"), F.struct("path", "section", "effective").alias("own")), "snapshot", "left")
    off = off.select("folder", F.coalesce("last", "own").alias("x")).select("folder", "x.*")
    once = Window.partitionBy("folder", "effective", "section").orderBy("path")
    clash = seen.where("fault = 'SAME_DATE_MEMBER_SNAPSHOT_CONFLICT'").withColumn("r", F.row_number().over(once)).where("r = 1")
    issues = _issue(seen.where("fault = 'INVALID_MEMBER_SNAPSHOT'"), "INVALID_MEMBER_SNAPSHOT").unionByName(_issue(clash, "SAME_DATE_MEMBER_SNAPSHOT_CONFLICT"))
    issues = issues.unionByName(_issue(later.join(people.select("folder", "path").distinct(), ["folder", "path"], "left_anti"), "UNPARSED_ALLOTMENT"))
    issues = issues.unionByName(_issue(rows.where("key = ''"), "ALLOTTEE_IDENTITY_MISSING")).unionByName(_issue(rows.join(given.where("own <> key").select("folder", "key", "name"), ["folder", "key", "name"], "left_semi"), "MEMBER_NAME_FALLBACK", "REVIEW"))
    return now, totals, issues.unionByName(_issue(off, "SHARE_RECONCILIATION"))


def total_shares(filings: DataFrame, totals: DataFrame) -> DataFrame:
    """folder and total: the latest one told, but what the members come to where an allotment is later than that."""
    dated = filings.where(F.col("section").isin(*TOTALS) & F.col("effective").isNotNull())
    order = rank(False)
    told, allotted = F.col("total_shares").isNotNull(), F.col("section") == "S78"
    one = dated.groupBy("folder").agg(F.max_by(F.when(told, F.col("total_shares")), F.when(told, order)).alias("explicit"), F.max(F.when(told, F.col("effective"))).alias("d"), F.max(F.when(allotted, F.col("effective"))).alias("a"))
    both = one.join(totals.select("folder", "member_total"), "folder", "full")
    later = (F.col("a") > F.col("d")) & F.col("member_total").isNotNull()
    return both.select("folder", F.when(later, F.col("member_total")).otherwise(F.coalesce("explicit", "member_total")).alias("total"))


def apply(now: dict[str, dict[str, str]], row, say: Callable[[str, str, object], None]) -> None:
    """One row (kind, key and fields) applied to a folder's directors by key; ``say`` gets (code, severity, row) of what is odd."""
    person = {f: getattr(row, f) for f in OFFICER_FIELDS if getattr(row, f)}
    key, alike = row.key, []
    if row.kind != "SNAPSHOT" and key not in now and person.get("name"):
        alike = [k for k, p in now.items() if p.get("name") == person["name"]]
        if len(alike) == 1:
            key = alike[0]
            say("DIRECTOR_NAME_FALLBACK", "REVIEW", row)
    if not key:
        if row.kind != "SNAPSHOT":
            say("DIRECTOR_IDENTITY_MISSING", "CRITICAL", row)
    elif row.kind == "CEASE":
        now.pop(key, None)
    else:
        merged = {**now.get(key, {}), **person}
        if row.kind == "UPDATE" and row.key and row.key != key and person.get("ic"):
            if row.key in now and now[row.key].get("name") != merged.get("name"):
                say("DIRECTOR_IDENTITY_REKEY_CONFLICT", "CRITICAL", row)
            else:
                now.pop(key, None)
                key = row.key
        now[key] = merged


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Directors of each folder after all its rows, and an issue for each that could not be applied; rows come by folder and order."""
    folder, now, out = None, {}, []

    def flush():
        for key, person in now.items():
            out.append((folder, key, *[person.get(f) or "" for f in OFFICER_FIELDS], None, None, None, None))

    def say(code, severity, row):
        out.append((row.folder, None, *[None] * len(OFFICER_FIELDS), severity, code, row.path, row.at))

    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.folder != folder:
                if folder is not None:
                    flush()
                folder, now = row.folder, {}
            apply(now, row, say)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=_FOLDED)
                out.clear()
    if folder is not None:
        flush()
    yield pd.DataFrame(out, columns=_FOLDED)


_FOLDED = ["folder", "key", *OFFICER_FIELDS, "severity", "code", "source_path", "effective_date"]


def _last_words(rows: DataFrame, order: Column) -> DataFrame:
    """folder, key and fields of directors whose rows don't end with a cessation: of each field the last value after the last one."""
    one = Window.partitionBy("folder", "key")
    rows = rows.withColumn("o", order).withColumn("ceased", F.max(F.when(F.col("kind") == "CEASE", F.col("o"))).over(one))
    live = rows.where((F.col("kind") != "CEASE") & (F.col("ceased").isNull() | (F.col("o") > F.col("ceased"))))
    return live.groupBy("folder", "key").agg(*[F.coalesce(F.max_by(f, F.when(F.col(f) != "", F.col("o"))), F.lit("")).alias(f) for f in OFFICER_FIELDS])


def _fields(df: DataFrame) -> list[Column]:
    return [clean(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) if f in df.columns else F.lit("").alias(f) for f in OFFICER_FIELDS]


def director_facts(filings: DataFrame, officers: DataFrame, events: DataFrame) -> DataFrame:
    """What directors' states are made of, for a stream of it: a row a person of a profile filing (SNAPSHOT) and a row a dated event.

    folder, path, kind, at (date), s, q and r (what orders filings of one day), key, and fields.
    """
    papers = filings.select("folder", "path", "section", "effective", section_rank(F.col("section")).alias("s"), F.coalesce("quality", F.lit(0)).alias("q"), F.coalesce("reference", F.lit("")).alias("r"))
    profiles = papers.where(F.col("section").isin(*DIRECTOR_SNAPSHOTS) & F.col("effective").isNotNull())
    told = officers.select("folder", "path", *_fields(officers)).join(profiles, ["folder", "path"]).select("folder", "path", F.lit("SNAPSHOT").alias("kind"), F.col("effective").alias("at"), "s", "q", "r", *OFFICER_FIELDS)
    dated = events.where(F.col("kind").isin(*OFFICER_KINDS) & F.col("event_date").isNotNull()).select("folder", "path", "kind", F.col("event_date").alias("at"), *_fields(events))
    noted = dated.join(papers.where("section = 'S58'").select("folder", "path", "s", "q", "r"), ["folder", "path"]).select(*told.columns)
    return told.unionByName(noted).withColumn("key", person_key(F.col("ic"), F.col("name")))


def directors(filings: DataFrame, officers: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current directors, issues).

    ``officers`` (folder, path, and fields) are the directors of profile filings, ``events``
    (folder, path, kind, event_date, and fields) come from notifications.  The last profile
    is the start; events on its day and after are applied in order.  Events of different
    kinds for one person on one day are left out, and so are undated ones.  Directors come
    with slot, by date of appointment (none first), then name.
    """
    key = person_key(F.col("ic"), F.col("name"))
    profiles = filings.where(F.col("section").isin(*DIRECTOR_SNAPSHOTS) & F.col("effective").isNotNull()).join(officers.select("folder", "path").distinct(), ["folder", "path"], "left_semi")
    base = profiles.groupBy("folder").agg(F.max(rank()).alias("top")).select("folder", F.col("top.path").alias("snapshot"), F.col("top.effective").alias("since"))
    start = officers.join(base, (officers["folder"] == base["folder"]) & (officers["path"] == base["snapshot"])).select(officers["folder"], officers["path"], F.lit("SNAPSHOT").alias("kind"), F.col("since").alias("at"), F.lit(0).alias("q"), F.lit("").alias("r"), *_fields(officers))
    notes = filings.where("section = 'S58'").select("folder", "path", "effective", F.coalesce("quality", F.lit(0)).alias("q"), F.coalesce("reference", F.lit("")).alias("r"))
    rows = events.where(F.col("kind").isin(*OFFICER_KINDS)).select("folder", "path", "kind", F.col("event_date").alias("at"), *_fields(events)).join(notes, ["folder", "path"])
    undated = rows.where("at is null").select("folder", "path", F.lit("S58").alias("section"), "effective")
    rows = rows.where("at is not null").drop("effective").withColumn("key", key).join(base.select("folder", "since"), "folder", "left").where("since is null or at >= since").drop("since")
    clash = rows.where("key <> ''").groupBy("folder", "at", "key").agg(F.count_distinct("kind").alias("n"), F.min("path").alias("path")).where("n > 1")
    rows = rows.join(clash.select("folder", "at", "key"), ["folder", "at", "key"], "left_anti")
    stream = start.withColumn("key", key).withColumn("turn", F.lit(0)).unionByName(rows.withColumn("turn", F.lit(1)))
    stream = _kept(filings.sparkSession, "directors")(stream.select("folder", "path", "kind", "at", "q", "r", "key", "turn", *OFFICER_FIELDS), "rows")
    # Where each name has one number and each row a number, the last word on each number decides; only the other folders are folded row by row.
    odd = stream.groupBy("folder", "name").agg(F.count_distinct("key").alias("n"), F.max(F.col("key") == "").alias("b")).where("n > 1 and name <> '' or b").select("folder").distinct()
    order = ("turn", "at", "q", "r", "path", "kind", "key")
    hard = stream.join(odd, "folder", "left_semi").repartition("folder").sortWithinPartitions("folder", *order)
    text = ", ".join(f"{f} string" for f in ("key", *OFFICER_FIELDS, "severity", "code", "source_path"))
    done = hard.select("folder", "path", "kind", "at", "key", *OFFICER_FIELDS).mapInPandas(_fold, f"folder string, {text}, effective_date date")
    done = done.unionByName(_last_words(stream.join(odd, "folder", "left_anti"), F.struct(*order)), allowMissingColumns=True)
    from karst.functions.values import LONG_DATES, parse_date

    appointed = F.coalesce(parse_date(F.col("appointment_date"), LONG_DATES), F.lit("0001-01-01").cast("date"))
    slot = F.row_number().over(Window.partitionBy("folder").orderBy(appointed, "name", "key"))
    now = done.where("code is null").select("folder", "key", *OFFICER_FIELDS).withColumn("slot", slot)
    issues = done.where("code is not null").select("folder", "severity", "code", "source_path", F.lit("S58").alias("section"), "effective_date")
    issues = issues.unionByName(_issue(undated, "UNDATED_DIRECTOR_EVENT")).unionByName(_issue(clash.select("folder", "path", F.lit("S58").alias("section"), F.col("at").alias("effective")), "SAME_DATE_DIRECTOR_CONFLICT"))
    return now, issues


def companies(filings: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row a folder, issues): the dates, name, number, total and addresses that its filings lead to.

    The profile is the last annual return, else the last section-14 form; a folder without
    one has no row and an issue.  ``filings`` may have company_name, registration_no,
    business_address and financial_address.
    """
    order, has = rank(False), lambda c: F.col(c) if c in filings.columns else F.lit(None).cast("string")
    dated = F.col("effective").isNotNull()
    is_ = lambda s: (F.col("section") == s) & dated
    latest = lambda c, when: F.max_by(c, F.when(when, order))
    lodged = lambda s: F.max(F.when(F.col("section") == s, F.col("lodged")))
    profile = (F.col("section") == "S68") & dated
    facts = F.struct(has("registration_no").alias("reg"), has("business_address").alias("business"), has("financial_address").alias("financial"))
    named = F.coalesce(has("company_name"), F.lit("")) != ""
    one = filings.groupBy("folder").agg(
        F.max(F.when(is_("S68"), F.col("effective"))).alias("annual_return_date"), F.max(F.when(is_("S14"), F.col("effective"))).alias("incorporate_date"), latest("lodged", profile).alias("lodgement_date"),
        lodged("S51").alias("section51_date"), lodged("S58").alias("section58_date"), lodged("S78").alias("section78_date"),
        latest(facts, profile).alias("by_return"), latest(facts, is_("S14")).alias("by_form"), latest(has("company_name"), named).alias("company_name"),
    )
    any_ = F.col("annual_return_date").isNotNull() | F.col("incorporate_date").isNotNull()
    p = F.when(F.col("annual_return_date").isNotNull(), F.col("by_return")).otherwise(F.col("by_form"))
    rows = one.where(any_).withColumn("p", p).join(totals.select("folder", F.col("total").alias("total_shares")), "folder", "left")
    rows = rows.select("folder", F.coalesce("company_name", "folder").alias("company_name"), F.col("p.reg").alias("registration_no"), "annual_return_date", "lodgement_date", "section51_date", "section58_date", "section78_date", "incorporate_date", "total_shares", F.col("p.business").alias("business_address"), F.col("p.financial").alias("financial_address"))
    none = one.where(~any_).select("folder", F.lit("CRITICAL").alias("severity"), F.lit("NO_PROFILE_SNAPSHOT").alias("code"), F.lit("").alias("source_path"), F.lit("").alias("section"), F.lit(None).cast("date").alias("effective_date"))
    return rows, none


def unread_events(filings: DataFrame, events: DataFrame) -> DataFrame:
    """Issues of notifications that show more operations (``expected``) than were read."""
    read = events.where(F.col("kind").isin(*OFFICER_KINDS)).groupBy("folder", "path").agg(F.count(F.lit(1)).alias("n"))
    rows = filings.where("section = 'S58' and expected > 0").join(read, ["folder", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < expected")
    return _issue(rows.where("n = 0"), "UNPARSED_DIRECTOR_FILING").unionByName(_issue(rows.where("n > 0"), "PARTIAL_DIRECTOR_EVENT_PARSE"))
