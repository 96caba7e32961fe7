"""Matching people across rosters: by identity where both have one, else by a unique name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_people(left: DataFrame, right: DataFrame, key: str, identity: str, name: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the one right row that has its identity, else of the one that has its name.

    Several rows of one identity, or of one name, match nothing.  Two equi-joins against
    aggregates with one row a key, so a repeated key cannot multiply rows.
    """
    def unique(column: str, out: str) -> DataFrame:
        rows = right.where(F.col(column).isNotNull() & (F.col(column) != ""))
        return rows.groupBy(F.col(column).alias(f"__karst_{out}")).agg(F.count("*").alias("__karst_n"), F.first(value).alias(f"__karst_{out}_v")).where("__karst_n = 1").drop("__karst_n")

    out = left.join(unique(identity, "i"), F.col(identity) == F.col("__karst_i"), "left").join(unique(name, "m"), F.col(name) == F.col("__karst_m"), "left")
    return out.select(*left.columns, F.coalesce("__karst_i_v", "__karst_m_v").alias(value))


def roster_conflicts(people: DataFrame, group: str, identity: str, name: str) -> DataFrame:
    """group, issue and subject: identities under several names, names under several identities."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    ids = people.where(has(identity)).groupBy(group, F.col(identity).alias("subject")).agg(F.count_distinct(name).alias("n")).where("n > 1").select(group, F.lit("SAME_ID_DIFFERENT_NAME").alias("issue"), "subject")
    names = people.where(has(name)).groupBy(group, F.col(name).alias("subject")).agg(F.count_distinct(identity).alias("n")).where("n > 1").select(group, F.lit("SAME_NAME_DIFFERENT_ID").alias("issue"), "subject")
    return ids.unionByName(names)


def associations(rows: DataFrame, keys: list[str], place: str, role: str, out: str = "roles") -> DataFrame:
    """One row a person and company (``keys``): the distinct roles in the order of ``place``."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct(place, role))), lambda r: r[role]).alias(out))


def holdings(people: DataFrame, keys: list[str], amount: str, label: str) -> DataFrame:
    """One row a person: amounts of distinct rows summed, distinct labels joined by a bar in order."""
    one = people.dropDuplicates([*keys, amount, label])
    return one.groupBy(*keys).agg(F.sum(amount).alias(amount), F.array_join(F.array_sort(F.collect_set(label)), " | ").alias(label))
