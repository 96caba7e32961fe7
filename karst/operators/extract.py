"""Typed rows out of semi-structured texts by labels and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions.text import clean


def labelled(text: Column, label: str, stops: tuple[str, ...] = ()) -> Column:
    """What follows ``label`` and a colon up to the next stop label or the line's end; null if there is nothing."""
    until = "|".join([r"\n", r"\z", *[rf"\b{s}\s*:" for s in stops]])
    return F.nullif(clean(F.regexp_extract(text, rf"(?is)\b{label}\s*:\s*(.*?)\s*(?={until})", 1)), F.lit(""))


def section(text: Column, start: str, ends: tuple[str, ...]) -> Column:
    """The text between ``start`` and the first of ``ends``, or its end."""
    return F.regexp_extract(text, rf"(?is)({start})(.*?)(?={'|'.join([*ends, chr(92) + 'z'])})", 2)


def blocks(df: DataFrame, text: str, splitter: str, out: str = "block") -> DataFrame:
    """A row for each part after a match of ``splitter``, with its number; what stands before the first is left out."""
    parts = F.slice(F.split(F.coalesce(F.col(text), F.lit("")), splitter), 2, 2**30)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("pos", out)).withColumn("pos", F.col("pos") + 1)


def key_values(text: Column, pattern: str) -> Column:
    """All matches of the pattern's first group."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def first_rule(text: Column, rules: dict[str, str], other: str) -> Column:
    """The name of the first rule whose pattern is found."""
    out = F.lit(other)
    for name, pattern in reversed(rules.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
