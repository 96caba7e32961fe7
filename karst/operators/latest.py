"""Current state of entities from dated events, and first, last and most frequent rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order (which should decide every tie)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__karst_n", F.row_number().over(w)).where("__karst_n = 1").drop("__karst_n")


def latest_state(df: DataFrame, keys: list[str], order: list[Column], ended: Column) -> DataFrame:
    """The last event of each group, unless it ends the state.  Ranking comes before the filter."""
    return pick(df, keys, order).where(~ended)


def canonical_value(df: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """key, value and n: the most frequent value of each key, ties to the one seen first.

    Two aggregates with partial sums; the key's values, not its rows, meet in one place.
    """
    seen = df.where(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(key, value).agg(F.count("*").alias("n"), F.min(ordinal).alias("__karst_first"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", (-F.col("__karst_first")).alias("f")))
    return seen.groupBy(key).agg(best.alias("__karst_b")).select(key, f"__karst_b.{value}", "__karst_b.n")


def last_filled(df: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """For each key and column the last value that is neither null nor blank."""
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    filled = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", at)
    return df.groupBy(key).agg(*[F.max_by(F.when(filled(c).isNotNull(), F.col(c)), filled(c)).alias(c) for c in columns])


def nearest(df: DataFrame, keys: list[str], date: Column, target: Column, ties: list[Column]) -> DataFrame:
    """The row of each group whose date is nearest to the target; a later one before an earlier one at equal distance."""
    gap = F.datediff(date, target)
    return pick(df.where(gap.isNotNull()), keys, [F.abs(gap).asc(), (gap < 0).asc(), *ties])
