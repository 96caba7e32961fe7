"""Finding an entity by name without ever guessing: an exact key, else a unique partial one, else nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions.text import registration_tokens, significant_tokens

#: Rows up to which a side is broadcast; a larger one is joined by shuffle.
SMALL = 100_000
#: Lengths of the pieces by which a part of a name is looked for.
GRAMS = (8, 4, 2, 1)
GRAM = GRAMS[0]


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def guarded_lookup(df: DataFrame, key: Column, term: str | Column) -> DataFrame:
    """Rows whose key equals ``term``; if none does, rows whose key contains it, provided they have one key between them.

    ``term`` is a text or an expression of literals, which the optimizer works out.  An empty
    term finds nothing.  Two aggregates of one row each decide; no row is sent to the driver.
    """
    term = F.lit(term) if isinstance(term, str) else term
    k = "__karst_key"
    near = df.withColumn(k, key).where((term != "") & F.contains(F.col(k), term))
    facts = near.agg(F.count_if(F.col(k) == term).alias("__karst_exact"), F.min(k).alias("__karst_lo"), F.max(k).alias("__karst_hi"))
    ok = (F.col(k) == term) | ((F.col("__karst_exact") == 0) & (F.col("__karst_lo") == F.col("__karst_hi")))
    return near.join(F.broadcast(facts), ok, "inner").drop(k, "__karst_exact", "__karst_lo", "__karst_hi")  # facts: one row


def guarded_lookup_many(df: DataFrame, key: str, terms: DataFrame, term: str) -> DataFrame:
    """``guarded_lookup`` for a column of terms: one row a term and found row.

    Exact matches are an equi-join.  Terms without one meet the distinct keys by their
    first letters: as many as a power of two up to ``GRAM``, which a key that holds the
    term has somewhere.  So that is an equi-join as well, and only then are both compared.
    """
    asked = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    exact = asked.join(df, asked["term"] == df[key])
    left = asked.join(df.select(F.col(key).alias("term")).distinct(), "term", "left_anti")
    keys = df.select(F.col(key).alias("__karst_full")).distinct()
    size = F.when(F.length("term") >= GRAM, GRAM)
    for n in GRAMS[1:]:
        size = size.when(F.length("term") >= n, n)
    # Keys are taken apart into pieces of those lengths alone that a term asks for: one row says which.
    asked_for = left.agg(F.collect_set(size).alias("__karst_n"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("__karst_full") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("__karst_full"), i, n))
    held = keys.crossJoin(F.broadcast(asked_for)).select("__karst_full", F.explode(F.array_distinct(F.flatten(F.transform("__karst_n", grams)))).alias("__karst_g"))
    part = left.withColumn("__karst_g", F.substring(F.col("term"), F.lit(1), size)).join(held, "__karst_g").where(F.contains("__karst_full", F.col("term"))).drop("__karst_g")
    one = part.groupBy("term").agg(F.min("__karst_full").alias("__karst_lo"), F.max("__karst_full").alias("__karst_hi")).where("__karst_lo = __karst_hi")
    return exact.unionByName(one.select("term", F.col("__karst_lo").alias("__karst_full")).join(df, F.col("__karst_full") == df[key]).drop("__karst_full"))


def ends_or_equals(key: Column, term: str) -> Column:
    """Equal, or ending with the term as a word; a term of several words must be equal."""
    return (key == term) if " " in term else (key == term) | key.endswith(" " + term)


def contains_either_way(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def by_shared_registration(df: DataFrame, matches: DataFrame, registration: str) -> DataFrame:
    """All rows that share a registration number with the matches (renamed entities); the matches if they have none."""
    own = matches.select(F.explode(registration_tokens(F.col(registration))).alias("__karst_r")).distinct()
    rows = df.withColumn("__karst_r", F.explode_outer(registration_tokens(F.col(registration)))).join(own, "__karst_r", "left_semi").drop("__karst_r").distinct()
    return rows.unionByName(matches).distinct()


def mentioned(names: DataFrame, key: str, texts: DataFrame, text_key: str, text_id: str) -> DataFrame:
    """(text_id, key) of the longest name all of whose significant tokens stand in a text; none if two tie.

    Names meet texts by the token that the fewest names have (an equi-join), then all
    tokens are checked, so no pair is formed that shares no token.  A text's words go
    into that join one by one; all of them are brought back for the few that met.
    """
    n = names.select(F.col(key).alias("name")).where("name <> ''").distinct().withColumn("tokens", significant_tokens(F.col("name"))).where("size(tokens) > 0")
    each = n.select("name", F.explode("tokens").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    lead = each.join(often, "t").groupBy("name").agg(F.min_by("t", F.struct("c", "t")).alias("lead"))
    n = n.join(lead, "name").withColumn("n", F.size("tokens"))
    t = texts.select(F.col(text_id).alias("id"), F.array_distinct(F.split(text_key, " ")).alias("words"))
    met = t.select("id", F.explode("words").alias("lead")).join(small(n), "lead").drop("lead")
    hit = met.join(t, "id").where(F.size(F.array_except("tokens", "words")) == 0)
    # Names of one token must be long enough to mean something.
    hit = hit.where((F.col("n") > 1) | (F.length("name") >= 5)).withColumn("size", F.length("name"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("size"))
    return hit.withColumn("r", F.rank().over(w)).where("r = 1").groupBy("id").agg(F.min("name").alias("name"), F.count_distinct("name").alias("c")).where("c = 1").select(F.col("id").alias(text_id), F.col("name").alias(key))
