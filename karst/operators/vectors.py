"""Nearest vectors by cosine, for a handful of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def top_k(df: DataFrame, vector: str, question: list[float], k: int, key: str, least: float | None = None) -> DataFrame:
    """The k rows most like ``question``, ties by key; only those of at least ``least``, if given.

    Sort and limit are one operator, so each task sends k rows.
    """
    ask = F.array(*[F.lit(float(x)) for x in question])
    rows = df.withColumn("score", cosine(F.col(vector), ask))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), key).limit(k)


def context(rows: DataFrame, text: str, order: list[Column], each: int = 1500, total: int = 4000) -> DataFrame:
    """One row: the texts in order, each cut to ``each`` characters, together to ``total``.  For the few rows of a top-k."""
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.substring(text, 1, each).alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(at)), lambda x: x["t"])
    return rows.where(F.trim(text) != "").agg(F.substring(F.array_join(texts, "\n\n"), 1, total).alias("context"))
