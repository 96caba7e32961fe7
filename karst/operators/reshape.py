"""Numbered column groups to rows and back, unions of roles, differences of snapshots."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots(columns: list[str], prefix: str, identity: str) -> list[int]:
    """1, 2, ... as long as ``prefix{n} identity`` is a column: the contiguous beginning only."""
    n = 0
    while f"{prefix}{n + 1} {identity}" in columns:
        n += 1
    return list(range(1, n + 1))


def unpivot_slots(df: DataFrame, prefix: str, identity: str, keep: list[str]) -> DataFrame:
    """A row for each slot whose identity is not blank: kept columns, slot, and the fields of the slots.

    One projection and one explode of an array of structs; no shuffle.  A field
    that a slot lacks is null there.
    """
    found = slots(df.columns, prefix, identity)
    fields = list(dict.fromkeys(m[1] for c in df.columns if (m := re.fullmatch(rf"{re.escape(prefix)}\d+ (.+)", c))))
    kind = {f: next(df.schema[c].dataType for c in df.columns if re.fullmatch(rf"{re.escape(prefix)}\d+ {re.escape(f)}", c)) for f in fields}
    field = lambda n, f: (F.col(f"`{prefix}{n} {f}`") if f"{prefix}{n} {f}" in df.columns else F.lit(None)).cast(kind[f]).alias(f)
    rows = F.array(*[F.struct(F.lit(n).alias("slot"), *[field(n, f) for f in fields]) for n in found])
    if not found:
        return df.select(*keep, F.lit(0).alias("slot")).limit(0)
    out = df.select(*keep, F.explode(rows).alias("__karst_s")).select(*keep, "__karst_s.*")
    return out.where(F.trim(F.col(f"`{identity}`").cast("string")) != "")


def pivot_slots(df: DataFrame, key: str, slot: str, fields: list[str], most: int, prefix: str) -> DataFrame:
    """One row a key with ``{prefix}{n} {field}`` columns for slots 1 to ``most``: conditional aggregates, one shuffle."""
    cells = [F.max(F.when(F.col(slot) == n, F.col(f))).alias(f"{prefix}{n} {f}") for n in range(1, most + 1) for f in fields]
    return df.groupBy(key).agg(*cells)


def union_roles(parts: dict[str, DataFrame], role: str = "role") -> DataFrame:
    """All rows with the role they come from; columns that a part lacks are null."""
    frames = [df.withColumn(role, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change (added, removed or changed) of every key that differs; nulls are equal to nulls."""
    a = old.select(F.col(key).alias("__a"), F.struct(*columns).alias("__x"))
    b = new.select(F.col(key).alias("__b"), F.struct(*columns).alias("__y"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__x").eqNullSafe(F.col("__y")), "changed")
    return both.select(F.coalesce("__a", "__b").alias(key), change.alias("change")).where("change is not null")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with rows of ``new`` in place of those of the same key; a column that ``new`` lacks is null in its rows."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_any(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``upsert`` by the first of several keys that finds a row: a row goes if any of its keys, none of them blank, is a new row's.

    Columns that only one side has are null on the other (a table grows by new columns).
    """
    left = existing
    for k in keys:
        mine = new.select(F.col(f"`{k}`").alias("__karst_k")).where(F.trim(F.col("__karst_k").cast("string")) != "").distinct()
        left = left.join(mine, left[f"`{k}`"] == mine["__karst_k"], "left_anti") if k in existing.columns and k in new.columns else left
    return left.unionByName(new, allowMissingColumns=True)


def slots_together(columns: list[str], prefix: str) -> list[str]:
    """Columns with those of ``prefix{n}`` side by side, slot by slot, where the first of them stands; all else keeps its order."""
    of = {c: int(m[1]) for c in columns if (m := re.match(rf"{re.escape(prefix)}(\d+) ", c))}
    if not of:
        return list(columns)
    own = sorted(of, key=lambda c: (of[c], columns.index(c)))
    at = next(i for i, c in enumerate(columns) if c in of)
    return [*columns[:at], *own, *[c for c in columns[at:] if c not in of]]


def issues(checks: dict[str, Column]) -> Column:
    """Codes of the checks that fail, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in checks.items()]), lambda x: x.isNotNull())
