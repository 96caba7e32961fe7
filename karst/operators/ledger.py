"""State of entities from validated snapshots and later changes, with conflicts as issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.operators.latest import pick


def keep_best(df: DataFrame, keys: list[str], order: list[Column], status: str = "status") -> DataFrame:
    """Marks all rows of a group but the best as DUPLICATE; rows with a null or blank key are left alone."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    # Rows without a key get a group of their own by ordinal, so they don't meet in one task.
    own = [F.when(~blank, F.col(k).cast("string")) for k in keys]
    alone = F.when(blank, F.xxhash64(*[F.col(c) for c in df.columns]))
    n = F.row_number().over(Window.partitionBy(*own, alone).orderBy(*order))
    return df.withColumn(status, F.when(~blank & (n > 1), "DUPLICATE").otherwise(F.col(status)))


def majority(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """key and value: the most frequent value of each key, ties to the one with the latest row."""
    n = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.count("*").alias("n"), F.max(order).alias("o"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", "o", value)).alias(value))


def quarantine(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """``df`` with ``ok``: whether the row's value is the majority of its key, or blank."""
    best = majority(df, key, value, order).withColumnRenamed(value, "__karst_v")
    ok = (F.col(value) == "") | F.coalesce(F.col(value) == F.col("__karst_v"), F.lit(True))
    ok = F.coalesce(ok, F.lit(True))
    return df.join(best, key, "left").withColumn("ok", ok).drop("__karst_v")


def conflicts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys and n_values of the groups that disagree."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def without_conflicts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Rows of the groups that agree: of a conflict nothing stays."""
    return df.join(conflicts(df, keys, value), keys, "left_anti")


def snapshot_plus_changes(snapshots: DataFrame, changes: DataFrame, key: str, subject: str, amount: str, date: str) -> DataFrame:
    """key, subject and amount: the latest snapshot of each key and the changes dated after it.

    A change on the snapshot's own date is held by the snapshot.  Keys without a snapshot have changes alone.
    """
    base = snapshots.groupBy(key).agg(F.max(date).alias("__karst_d"))
    held = snapshots.join(base, key).where(F.col(date) == F.col("__karst_d")).select(key, subject, amount)
    later = changes.join(base, key, "left").where(F.col("__karst_d").isNull() | (F.col(date) > F.col("__karst_d"))).select(key, subject, amount)
    return held.unionByName(later).groupBy(key, subject).agg(F.sum(amount).alias(amount))


def snapshot_plus_events(snapshots: DataFrame, events: DataFrame, key: str, subject: str, date: str, kind: str, order: list[Column]) -> DataFrame:
    """key and subject of those who hold office: in the latest snapshot or appointed from its date on, and not ceased last.

    Events on the snapshot's own date count.  Subjects with different kinds of event on one day are
    suppressed for that day; what they were before stays.
    """
    base = snapshots.groupBy(key).agg(F.max(date).alias("__karst_d"))
    held = snapshots.join(base, key).where(F.col(date) == F.col("__karst_d")).select(key, subject, F.lit("SNAPSHOT").alias(kind), F.col(date), F.lit(0).alias("__karst_o"))
    live = without_conflicts(events, [key, subject, date], F.col(kind))
    live = live.join(base, key, "left").where(F.col("__karst_d").isNull() | (F.col(date) >= F.col("__karst_d"))).select(key, subject, F.col(kind), F.col(date), F.lit(1).alias("__karst_o"))
    last = pick(held.unionByName(live), [key, subject], [F.desc(date), F.desc("__karst_o"), *order])
    return last.where(F.col(kind) != "CEASE").select(key, subject)


def allocate(df: DataFrame, key: str, order: list[Column], weight: str, total: Column, out: str) -> DataFrame:
    """``total`` shared out by weight in hundredths, halves up; the last row of a key takes what remains."""
    w = Window.partitionBy(key)
    n = Window.partitionBy(key).orderBy(*order)
    cents = F.round(total * 100 * F.col(weight) / F.sum(weight).over(w)).cast("long")
    before = n.rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("__karst_c").over(before), F.lit(0))
    rows = df.withColumn("__karst_c", cents).withColumn("__karst_t", F.round(total * 100).cast("long")).withColumn("__karst_n", F.row_number().over(n)).withColumn("__karst_m", F.count("*").over(w))
    return rows.withColumn(out, F.when(F.col("__karst_n") == F.col("__karst_m"), F.col("__karst_t") - share).otherwise(F.col("__karst_c"))).drop("__karst_c", "__karst_t", "__karst_n", "__karst_m")


def rollup(n: Column, good: Column, bad: Column, missing: Column) -> Column:
    """The status of a group from its counts: not_found if all are missing, success if none is bad, error if none is good, else partial."""
    return F.when(missing == n, "not_found").when(bad == 0, "success").when(good == 0, "error").otherwise("partial")


def event_log(parts: dict[str, DataFrame], key: str, date: str) -> DataFrame:
    """Rows of all tables as events: event, key, date and payload, all other columns as JSON with nulls written out."""
    def one(name: str, df: DataFrame) -> DataFrame:
        payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (key, date)]), {"ignoreNullFields": "false"})
        return df.select(F.lit(name).alias("event"), F.col(key), F.to_date(date).alias(date), payload.alias("payload"))

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in parts.items()])


def histogram(issues: DataFrame, code: str) -> DataFrame:
    return issues.groupBy(code).agg(F.count("*").alias("n"))


def reconcile(parts: DataFrame, totals: DataFrame, key: str, amount: str, total: str) -> DataFrame:
    """key, sum, total and issue for every key whose parts don't add up, are negative, or lack a total."""
    sums = parts.groupBy(key).agg(F.sum(amount).alias("summed"), F.min(amount).alias("least"))
    both = sums.join(totals.select(key, total), key, "full_outer")
    issue = F.when(F.col(total).isNull(), "TOTAL_MISSING").when(F.col("summed").isNull(), "PARTS_MISSING").when(F.col("least") < 0, "NEGATIVE").when(F.col("summed") != F.col(total), "MISMATCH")
    return both.withColumn("issue", issue).where("issue is not null").select(key, "summed", total, "issue")
