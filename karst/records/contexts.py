"""Document contexts: what several registers say of a company, with everything that stands against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import entity_key, first_filled, identity_key, name_key
from karst.operators.ledger import allocate
from karst.operators.reshape import issues
from karst.records.companies import q


def provenance(value: Column, source: str, date: Column | None = None, candidates: Column | None = None) -> Column:
    """A value with where it comes from; its status is filled, suggested (blank, with candidates) or missing."""
    v = F.nullif(F.trim(value), F.lit(""))
    c = candidates if candidates is not None else F.array().cast("array<string>")
    status = F.when(v.isNotNull(), "filled").when(F.size(c) > 0, "suggested").otherwise("missing")
    return F.struct(v.alias("value"), F.lit(source).alias("source"), (date if date is not None else F.lit(None).cast("date")).alias("source_date"), status.alias("status"), c.alias("candidates"))


def first_source(sources: dict[str, Column]) -> Column:
    """struct(value, source) of the first source that has a value."""
    out = F.lit(None).cast("struct<value:string,source:string>")
    for name, c in reversed(sources.items()):
        v = F.nullif(F.trim(c), F.lit(""))
        out = F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(name).alias("source"))).otherwise(out)
    return out


def company_contexts(companies: DataFrame, registers: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A row a company: its columns, a struct for each register, and ``issues``.

    A register is (table, name column).  It is found by company name; none is
    ``{register}_not_found``, several are ``{register}_ambiguous``, and a register's own number that is
    another is ``{register}_registration_mismatch``.  Registers are aggregated to
    a row a name before they are joined, so no join multiplies rows.
    """
    out = companies.withColumn("__k", entity_key(q("Company Name")))
    checks = {"missing_company_name": F.coalesce(F.trim(q("Company Name")), F.lit("")) == "", "missing_registration_no": F.coalesce(F.trim(q("Reg No")), F.lit("")) == ""}
    for name, (df, column) in registers.items():
        rows = df.groupBy(entity_key(q(column)).alias(f"__{name}_k")).agg(F.count("*").alias(f"__{name}_n"), F.first(F.struct(*[q(c) for c in df.columns])).alias(name))
        out = out.join(rows, F.col("__k") == F.col(f"__{name}_k"), "left").withColumn(name, F.when(F.col(f"__{name}_n") == 1, F.col(name)))
        checks |= {f"{name}_not_found": F.col(f"__{name}_n").isNull(), f"{name}_ambiguous": F.col(f"__{name}_n") > 1}
        if "Reg No" in df.columns:
            other = F.coalesce(identity_key(F.col(f"{name}.`Reg No`")), F.lit(""))
            checks[f"{name}_registration_mismatch"] = (other != "") & (other != identity_key(q("Reg No")))
    out = out.withColumn("issues", issues(checks))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def date_order(dates: dict[str, Column]) -> Column:
    """Codes of neighbouring dates that stand in the wrong order, and of missing ones."""
    names = list(dates)
    checks = {f"missing_{n}": c.isNull() for n, c in dates.items()} | {f"{a}_after_{b}": dates[a] > dates[b] for a, b in zip(names, names[1:])}
    return issues(checks)


def fees(total: Column, members: DataFrame, directors: DataFrame, key: str, name: str, shares: str) -> DataFrame:
    """``total`` shared out among the members who are directors, by shares, to the cent."""
    eligible = members.withColumn("__n", name_key(F.col(name))).join(directors.select(F.col(key), name_key(F.col(name)).alias("__n")).distinct(), [key, "__n"], "left_semi").drop("__n")
    return allocate(eligible, key, [F.desc(shares), F.asc(name)], shares, total, "cents")


def rosters(people: DataFrame, key: str, name: str) -> DataFrame:
    """key and name of people who are twice on one roster."""
    return people.groupBy(key, name_key(F.col(name)).alias("name_key")).agg(F.count("*").alias("n")).where("n > 1 AND name_key <> ''")


def owner_test(shares: Column, total: Column, criteria_c: Column) -> Column:
    """Whether someone counts as an owner: a fifth of all shares, or by the third criterion."""
    c = F.upper(F.coalesce(F.trim(criteria_c), F.lit("")))
    return (shares * 100 >= total * 20) | ~c.isin("", "N/A", "NONE", "-", "0")


def owners_of(holders: DataFrame, key: str, shares: str, criteria_c: str | None = None) -> DataFrame:
    """Holders who count as owners (``owner_test``) of what all holders of their key have together.

    The total is an aggregate that is joined back, so a key with very many holders is summed before it is shuffled.
    """
    total = holders.groupBy(F.col(key).alias("__k")).agg(F.sum(shares).alias("__t"))
    own = F.col(criteria_c) if criteria_c else F.lit(None).cast("string")
    return holders.join(total, F.col(key) == F.col("__k")).where(owner_test(F.col(shares), F.col("__t"), own)).drop("__k", "__t")


def enriched(current: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` with blanks filled from the one row of ``other`` with its key."""
    one = other.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__c"), *[F.first(q(c)).alias(f"__{i}") for i, c in enumerate(columns)]).where("__c = 1")
    out = current.join(one, F.col(key) == F.col("__k"), "left")
    return out.withColumns({c: first_filled(q(c), F.col(f"__{i}")) for i, c in enumerate(columns)}).select(*[q(c) for c in current.columns])
