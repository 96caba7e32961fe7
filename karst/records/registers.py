"""Auditors, constitutions, financial statements and new companies: one table each, found by company name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions.text import auditor_key, entity_key, name_key
from karst.operators.latest import canonical_value, pick
from karst.operators.lookup import ends_or_equals, guarded_lookup
from karst.records.companies import q
from karst.sources.tables import require

# The columns that each register must have.
AUDITOR = ["Company Name", "Reg No", "Financial Year End", "Auditor Firm No", "Auditor Name", "Auditor Address"]
CONSTITUTION = ["Company Name", "Reg No", "DIRECTOR WRITTEN RESOLUTION (DWR Statutory)", "MEMBER WRITTEN RESOLUTION (MWR Statutory)"]


class Register:
    """A table with a row a company; ``&`` in names is AND unless ``plain``."""

    def __init__(self, df: DataFrame, required: list[str], name: str = "Company Name", plain: bool = False):
        self.df, self.name, self.key = require(df, required), name, name_key if plain else entity_key

    def company(self, name: str) -> DataFrame:
        return guarded_lookup(self.df, self.key(q(self.name)), self.key(F.lit(name)))

    def information(self, fields: list[str], name: str | None = None) -> DataFrame:
        known = [f for f in dict.fromkeys(fields) if f in self.df.columns and f != self.name]
        rows = self.df.orderBy(q(self.name).asc_nulls_last()) if name is None else self.company(name)
        return rows.select(q(self.name), *[q(f) for f in known])

    def names(self) -> DataFrame:
        return self.df.select(q(self.name)).where(F.trim(q(self.name)) != "").distinct()


class Auditors(Register):
    """Spellings of one auditor are brought together under the most frequent, ties to the first row's."""

    def __init__(self, df: DataFrame, ordinal: str):
        super().__init__(df, [*AUDITOR, ordinal])
        self.ordinal = ordinal

    def canonical(self) -> DataFrame:
        """All rows with ``auditor`` (canonical name), ``auditor_key`` and ``company_key`` (number, else name)."""
        rows = self.df.withColumn("auditor_key", auditor_key(q("Auditor Name")))
        # A single letter at the end goes if the name without it is there, too.
        short = F.regexp_replace("auditor_key", " [A-Z]$", "")
        keys = rows.select(F.col("auditor_key").alias("k")).where("k <> ''").distinct()
        rows = rows.withColumn("s", short).join(keys, F.col("s") == F.col("k"), "left")
        rows = rows.withColumn("auditor_key", F.coalesce("k", "auditor_key")).drop("s", "k")
        best = canonical_value(rows.select("auditor_key", F.trim(q("Auditor Name")).alias("auditor"), self.ordinal).where("auditor_key <> ''"), "auditor_key", "auditor", self.ordinal)
        rows = rows.join(best.select("auditor_key", "auditor"), "auditor_key", "left")
        return rows.withColumn("company_key", F.when(F.trim(q("Reg No")) != "", name_key(q("Reg No"))).otherwise(entity_key(q("Company Name"))))

    def companies(self) -> DataFrame:
        """One row a company, the first, by name."""
        return pick(self.canonical(), ["company_key"], [F.asc(self.ordinal)]).orderBy(q("Company Name").asc_nulls_last())

    def distinct(self) -> DataFrame:
        rows = self.canonical().where("auditor_key <> ''")
        return rows.groupBy("auditor_key", "auditor").agg(F.count_distinct("company_key").alias("companies")).orderBy("auditor").drop("auditor_key")

    def of_company(self, name: str) -> DataFrame:
        found = self.company(name).select(F.col(self.ordinal).alias("o"))
        rows = self.canonical().join(found, F.col(self.ordinal) == F.col("o"), "left_semi")
        return pick(rows, ["company_key"], [F.asc(self.ordinal)])

    def by_auditor(self, auditor: str) -> DataFrame:
        """Companies of the auditor that the name means: its key, else the one key that holds it or is held by it."""
        from karst.operators.lookup import contains_either_way

        rows = self.companies()
        key = auditor_key(F.lit(auditor))
        near = rows.where((key != "") & ((F.col("auditor_key") == key) | contains_either_way(F.col("auditor_key"), key)))
        facts = near.agg(F.count_if(F.col("auditor_key") == key).alias("__n"), F.count_distinct("auditor_key").alias("__d"))
        ok = (F.col("auditor_key") == key) | ((F.col("__n") == 0) & (F.col("__d") == 1))
        return near.join(F.broadcast(facts), ok).drop("__n", "__d").orderBy(q("Company Name"))  # one row

    def display_name(self, auditor: str) -> DataFrame:
        """The name by which the auditor goes that ``auditor`` means (as in ``by_auditor``): one row, or none."""
        return self.by_auditor(auditor).select("auditor").distinct()

    def by_year_end(self, year_end: str) -> DataFrame:
        return self.companies().where(ends_or_equals(name_key(q("Financial Year End")), year_end.upper().strip())).orderBy(q("Company Name"))
