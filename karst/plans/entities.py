"""Which company, auditor or person a question names, found among all names without guessing.

Questions and names are tables, so many questions are answered by one join: names meet
questions by their rarest token, then their tokens are compared.  An exact mention wins
over an alias, an alias over a mention of all significant tokens; the longest wins, and
of several that are equally good there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions.text import auditor_key, name_key, significant_tokens
from karst.operators.latest import pick

#: Questions of one word up to which they meet names in one task.
OFTEN = 100_000
#: Characters that a name of one significant token must have.
LEAST_SINGLE = 5


def lookup(rows: DataFrame, name: str, ordinal: str) -> DataFrame:
    """key and name of a register: of several spellings of one key the last row's."""
    keyed = rows.select(name_key(F.col(name)).alias("key"), F.trim(name).alias("name"), F.col(ordinal).alias("o")).where("key <> ''")
    return keyed.groupBy("key").agg(F.max_by("name", "o").alias("name"))


def universe(registers: list[DataFrame]) -> DataFrame:
    """key and name over all registers (``lookup``s); the first register that has a key gives its name."""
    rows = reduce(DataFrame.unionByName, [r.select("key", "name", F.lit(i).alias("i")) for i, r in enumerate(registers)])
    return pick(rows, ["key"], [F.asc("i")]).select("key", "name")


def people(columns: list[DataFrame]) -> DataFrame:
    """key and name of all people of one-column tables; of several spellings the least."""
    rows = reduce(DataFrame.union, [c.toDF("name") for c in columns]).select(name_key(F.col("name")).alias("key"), F.trim("name").alias("name")).where("key <> ''")
    return rows.groupBy("key").agg(F.min("name").alias("name"))


def _met(questions: DataFrame, names: DataFrame, key: Column, tokens: Column) -> DataFrame:
    """Pairs of a question (id, q, words) and a name whose tokens all stand in it.

    They meet by the name's token that the fewest names have, so a word that all names share makes no pairs.
    Nor do questions of one word meet in one task, however many they are.
    """
    n = names.withColumn("k", key).withColumn("tokens", tokens).where((F.col("k") != "") & (F.size("tokens") > 0))
    each = n.select("k", "name", F.explode("tokens").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    lead = each.join(often, "t").groupBy("k", "name").agg(F.min_by("t", F.struct("c", "t")).alias("lead"))
    n = n.join(lead, ["k", "name"])
    # Words that very many questions share are few; those that lead no name go, the others' questions are dealt over several groups.
    asked = questions.select("id", F.explode("words").alias("lead"))
    often = asked.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > OFTEN)
    often = often.join(n.select("lead").distinct().withColumn("leads", F.lit(True)), "lead", "left").select("lead", F.coalesce("leads", F.lit(False)).alias("leads"), F.ceil(F.col("c") / OFTEN).cast("int").alias("groups"))
    often = F.broadcast(often)  # one row at most for each OFTEN words of all questions
    q = questions.withColumn("lead", F.explode("words")).join(often, "lead", "left").where("leads is null or leads")
    q = q.withColumn("g", F.pmod(F.xxhash64("id"), F.coalesce("groups", F.lit(1))).cast("int")).drop("leads", "groups")
    n = n.join(often, "lead", "left").withColumn("g", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1))).drop("leads", "groups")
    # The leads of a question are its own few words; its text goes along once a name met.
    return q.join(n, ["lead", "g"]).drop("g").where(F.size(F.array_except("tokens", "words")) == 0)


def _best(met: DataFrame, order: list[Column], name: str = "name") -> DataFrame:
    """The one name that is best by ``order``; no row if several are."""
    r = F.rank().over(Window.partitionBy("id").orderBy(*order))
    return met.withColumn("r", r).where("r = 1").groupBy("id").agg(F.min(name).alias("name"), F.count_distinct(name).alias("c")).where("c = 1").select("id", "name")


def _asked(questions: DataFrame, key) -> DataFrame:
    q = questions.select("id", key(F.col("text")).alias("q")).where("q <> ''")
    return q.withColumn("words", F.array_distinct(F.split("q", " ")))


def _exact() -> Column:
    return F.contains(F.concat(F.lit(" "), F.col("q"), F.lit(" ")), F.concat(F.lit(" "), F.col("k"), F.lit(" ")))


def companies_named(questions: DataFrame, names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """id and name: the company that each question (id, text) names, of ``names`` (key, name) and ``aliases`` (alias, name)."""
    q = _asked(questions, name_key)
    whole = _best(_met(q, names, F.col("key"), F.split("key", " ")).where(_exact()), [F.desc(F.length("k"))])
    steps = [whole]
    if aliases is not None:
        a = name_key(F.col("alias"))
        steps.append(_best(_met(q, aliases, a, F.split(a, " ")).where(_exact()), [F.desc(F.length("k"))]))
    some = _met(q, names, F.col("key"), significant_tokens(F.col("key"))).where((F.size("tokens") > 1) | (F.length(F.get("tokens", F.lit(0))) >= LEAST_SINGLE))
    steps.append(_best(some, [F.desc(F.size("tokens")), F.desc(F.length("k"))]))
    rows = reduce(DataFrame.unionByName, [s.withColumn("i", F.lit(i)) for i, s in enumerate(steps)])
    return pick(rows, ["id"], [F.asc("i")]).select("id", "name")


def auditors_named(questions: DataFrame, auditors: DataFrame) -> DataFrame:
    """id and name: the auditor (of one column ``name``) by its whole key, else by its tokens that tell it from others."""
    q, key = _asked(questions, auditor_key), auditor_key(F.col("name"))
    names = auditors.select("name").distinct()
    whole = _best(_met(q, names, key, F.split(key, " ")).where(_exact()), [F.desc(F.length("k"))])
    some = _best(_met(q, names, key, significant_tokens(key, ("AND", "CO", "PLT", "ASSOCIATES", "PARTNERS", "COMPANY"))), [F.desc(F.size("tokens"))])
    rows = whole.withColumn("i", F.lit(0)).unionByName(some.withColumn("i", F.lit(1)))
    return pick(rows, ["id"], [F.asc("i")]).select("id", "name")


def people_named(questions: DataFrame, known: DataFrame) -> DataFrame:
    """id and name: the person (key, name) all of whose name stands in the question, in any order; the longest."""
    met = _met(_asked(questions, name_key), known, F.col("key"), F.array_distinct(F.split("key", " ")))
    return _best(met, [F.desc(F.size("tokens")), F.desc(F.length("k"))])


def auditor_aliases(clients: DataFrame, auditors: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias and name: what the auditors' register calls the company that an alias (alias, entity) means among the clients.

    Clients and register are (name, number): by number if the register has it, else by name.
    A number or name that the register has for several companies tells none.
    """
    key = lambda c: F.coalesce(name_key(F.col(c)), F.lit(""))

    def once(by: str, out: str) -> DataFrame:
        rows = auditors.select(key(by).alias(f"__{out}"), F.trim("name").alias(out)).where(F.col(f"__{out}") != "")
        return rows.groupBy(f"__{out}").agg(F.min(out).alias(out), F.count_distinct(out).alias("c")).where("c = 1").drop("c")

    client = clients.select(key("name").alias("k"), key("number").alias("n")).where("k <> ''").groupBy("k").agg(F.min(F.nullif("n", F.lit(""))).alias("n"))
    rows = aliases.select("alias", key("entity").alias("k")).join(client, "k")
    rows = rows.join(once("number", "by_number"), F.col("n") == F.col("__by_number"), "left").join(once("name", "by_name"), F.col("k") == F.col("__by_name"), "left")
    return rows.select("alias", F.coalesce("by_number", "by_name").alias("name")).where("name is not null")


def auditor_companies_named(questions: DataFrame, clients: DataFrame, auditors: DataFrame, aliases: DataFrame) -> DataFrame:
    """id and name: the company of the auditors' register (name, number, ordinal) that each question names, by its own name or an alias of the client."""
    return companies_named(questions, lookup(auditors, "name", "ordinal"), auditor_aliases(clients, auditors, aliases))
