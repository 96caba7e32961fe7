"""Companies with their directors and members in numbered column groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions.text import name_key
from karst.operators.latest import pick
from karst.operators.lookup import guarded_lookup
from karst.operators.reshape import unpivot_slots
from karst.sources.tables import require

NAME, REG, FOLDER, AR_DATE = "Company Name", "Reg No", "Folder", "Annual Return Date"
#: Slots that are looked at, at most.
MOST = 49


def q(c: str):
    return F.col(f"`{c}`")


class Companies:
    """``df``: a row a company. ``ledgers``: the filing tables by name, each with Folder and an ordinal."""

    def __init__(self, df: DataFrame, ordinal: str, ledgers: dict[str, DataFrame] | None = None):
        self.df, self.ordinal, self.ledgers = require(df, [FOLDER, NAME, REG, ordinal]), ordinal, ledgers or {}

    def all(self) -> DataFrame:
        return self.df.orderBy(q(NAME).asc_nulls_last(), self.ordinal)

    def names(self) -> DataFrame:
        """Names once each; of several spellings the first row's."""
        rows = self.df.where(name_key(q(NAME)) != "").select(NAME, self.ordinal, name_key(q(NAME)).alias("key"))
        return pick(rows, ["key"], [F.asc(self.ordinal)]).orderBy("key", NAME).select(NAME)

    def company(self, name: str) -> DataFrame:
        return guarded_lookup(self.df, name_key(q(NAME)), name_key(F.lit(name)))

    def information(self, fields: list[str], name: str | None = None) -> DataFrame:
        """The name and the known fields, each once; no rows if no field is known."""
        known = [f for f in dict.fromkeys(fields) if f in self.df.columns and f != NAME]
        rows = self.all() if name is None else self.company(name)
        return rows.select(NAME, *[q(f) for f in known]) if known else rows.select(NAME).limit(0)

    def annual_return_dates(self, name: str | None = None) -> DataFrame:
        return self.information([AR_DATE], name)

    def _people(self, prefix: str, name: str | None) -> DataFrame:
        rows = self.df if name is None else self.company(name)
        people = unpivot_slots(rows, prefix, "Name", [NAME, REG]).where(F.col("slot") <= MOST)
        return people.orderBy(name_key(q(NAME)), name_key(F.col("Name")), "slot")

    def directors(self, name: str | None = None) -> DataFrame:
        return self._people("Director", name)

    def shareholders(self, name: str | None = None) -> DataFrame:
        return self._people("Member", name)

    def _of(self, people: DataFrame, person: str) -> DataFrame:
        return people.where((name_key(F.col("Name")) == name_key(F.lit(person))) & (name_key(F.lit(person)) != ""))

    def directorships(self, person: str) -> DataFrame:
        return self._of(self.directors(), person)

    def shareholdings(self, person: str) -> DataFrame:
        rows = self._of(self.shareholders(), person)
        return rows.select(F.lit("Current").alias("Status"), *rows.columns)

    def associations(self, person: str) -> DataFrame:
        """Companies a person directs or holds, with roles in order; companies are one by number, else by name."""
        key = F.when(F.trim(q(REG)) != "", q(REG)).otherwise(name_key(q(NAME)))
        part = lambda df, n, role: df.select(key.alias("key"), NAME, REG, F.lit(n).alias("n"), F.lit(role).alias("role"))
        rows = part(self.directorships(person), 1, "Director").union(part(self.shareholdings(person), 2, "Shareholder"))
        roles = F.transform(F.array_sort(F.collect_set(F.struct("n", "role"))), lambda x: x["role"])
        at = F.struct("n", NAME)
        return rows.groupBy("key").agg(F.min_by(NAME, at).alias(NAME), F.min_by(REG, at).alias(REG), roles.alias("Roles")).drop("key").orderBy(NAME)

    def ledger(self, table: str, name: str | None = None) -> DataFrame:
        """Rows of a filing table, of all companies or of the one company's folder."""
        rows = self.ledgers[table]
        if name is not None:
            folder = pick(self.company(name).select(F.trim(FOLDER).alias("f"), self.ordinal, F.lit(1).alias("one")), ["one"], [F.asc(self.ordinal)]).where("f <> ''").select("f")
            rows = rows.join(F.broadcast(folder), rows[FOLDER] == folder["f"], "left_semi")  # one row
        return rows.orderBy(FOLDER, *[c for c in [self.ordinal] if c in rows.columns])

    def folders_changed(self, newer: DataFrame) -> DataFrame:
        from karst.operators.reshape import snapshot_diff

        shared = [c for c in self.df.columns if c in newer.columns and c not in (FOLDER, "UpdatedAt", self.ordinal)]
        return snapshot_diff(self.df, newer, FOLDER, [f"`{c}`" for c in shared])
