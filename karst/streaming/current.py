"""Current state and windowed counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events once each, however often they are delivered within ``late``; the state forgets older keys."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, by: str, ts: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def latest(events: DataFrame, key: str, order: list[str], ended: str) -> DataFrame:
    """The last event of each key so far, with whether it ends the state (update or complete mode).

    An arg-max is one value a key in the state store, and late events fall into place by themselves.
    """
    at = F.struct(*order)
    rows = events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), at).alias("e")).select(key, "e.*")
    return rows.withColumn("ended", F.expr(ended))
