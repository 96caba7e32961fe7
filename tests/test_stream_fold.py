import random

import pytest
from pyspark.sql import functions as F

from karst.records import state
from karst.streaming import directors
from karst.streaming.incremental import Incremental

FILING = "folder string, path string, section string, effective date, quality int, reference string"
PERSON = "folder string, path string, kind string, event_date date, ic string, name string"


def facts(spark, seed=1, folders=5, n=90):
    rng = random.Random(seed)
    filings, people = [], []
    for i in range(n):
        folder, day, p = f"F{rng.randrange(folders)}", f"2024-01-{1 + rng.randrange(25):02d}", f"p{i:03d}"
        kind = rng.choice(["SNAPSHOT", *["APPOINT", "UPDATE", "CEASE"] * 4])
        filings.append((folder, p, "S68" if kind == "SNAPSHOT" else "S58", day, rng.choice([1, 2]), ""))
        for _ in range(3 if kind == "SNAPSHOT" else 1):
            who = rng.randrange(6)
            people.append((folder, p, kind, day, rng.choice([f"I{who}", f"I{who}", ""]), f"N{who}"))
    f = spark.createDataFrame(filings, FILING.replace("effective date", "effective string")).withColumn("effective", F.to_date("effective"))
    e = spark.createDataFrame(people, PERSON.replace("event_date date", "event_date string")).withColumn("event_date", F.to_date("event_date")).distinct()
    return f, e.where("kind = 'SNAPSHOT'").drop("kind", "event_date"), e.where("kind <> 'SNAPSHOT'")


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", directors.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, parts, late, again=False):
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/{'in'}/b{i:03d}")
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    table = Incremental(spark, f"{tmp_path}/out", ["folder"], ["version"])
    q = table.follow(directors.follow(source, late), f"{tmp_path}/cp", compact_every=4)
    q.awaitTermination()
    return table, q


def rows(df):
    return sorted((r.folder, r.key, r.name, r.ic) for r in df.collect())


@pytest.mark.parametrize("ordered", [False, True])
def test_a_stream_ends_in_the_state_of_the_batch(spark, tmp_path, store, ordered):
    f, o, e = facts(spark)
    want, want_issues = state.directors(f, o, e)
    every = state.director_facts(f, o, e).cache()
    if ordered:  # days in order: what is settled is forgotten, and still counts
        parts = [every.where(F.dayofmonth("at").between(a, a + 4)) for a in range(1, 26, 5)]
    else:
        dealt = every.withColumn("b", F.pmod(F.xxhash64("path"), F.lit(6)))
        parts = [dealt.where(F.col("b") == i).drop("b") for i in range(6)]
        parts.append(parts[2])  # delivered again
    table, q = streamed(spark, tmp_path, parts, "2 days" if ordered else "400 days")
    got = table.read()
    assert rows(got.select("folder", F.inline("directors"))) == rows(want)
    issues = lambda df: sorted((r.folder, r.code, r.source_path) for r in df.where("code <> 'UNDATED_DIRECTOR_EVENT'").collect())
    assert issues(got.select("folder", F.inline("issues"))) == issues(want_issues)
    if ordered:
        kept = [x["numRowsTotal"] for p in q.recentProgress for x in p["stateOperators"]]
        assert kept[-1] < every.count()


def test_batches_count_once(spark, tmp_path):
    table = Incremental(spark, f"{tmp_path}/t", ["k"], ["v"])
    assert table.read() is None
    batch = lambda *rows: spark.createDataFrame(rows, "k long, v long, x string")
    parts = [batch((1, 1, "a"), (2, 5, "b"), (None, 1, "n")), batch((1, 2, "c"), (2, 4, "late")), batch((3, 1, "d"), (1, 2, "e"))]
    for i, p in enumerate(parts):
        assert table.apply(p, i) and not table.apply(batch((9, 9, "again")), i)
    want = [(None, 1, "n"), (1, 2, "e"), (2, 5, "b"), (3, 1, "d")]
    read = lambda: sorted((tuple(r)[:3] for r in table.read().collect()), key=str)
    assert read() == sorted(want, key=str)
    table.compact()
    assert read() == sorted(want, key=str) and table.batches() == [] and not table.apply(parts[0], 1)
    assert table.apply(spark.createDataFrame([(4, 1, "f", 7)], "k long, v long, x string, y int"), 3)
    assert read() == sorted([*want, (4, 1, "f")], key=str) and [r.y for r in table.read().orderBy("k").collect()] == [None, None, None, None, 7]
    once = Incremental(spark, f"{tmp_path}/u", ["k"], ["v"])
    once.apply(parts[0].union(parts[1]).union(batch((3, 1, "d"), (1, 3, "e"))), 0)
    assert sorted((r.k or 0, r.x) for r in once.read().collect()) == [(0, "n"), (1, "e"), (2, "b"), (3, "d")]


def test_a_batch_that_breaks_off_leaves_nothing(spark, tmp_path):
    table = Incremental(spark, f"{tmp_path}/t", ["k"])
    bad = spark.range(5).select(F.col("id").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        table.apply(bad, 0)
    assert table.read() is None and table.batches() == [] and table.apply(spark.range(5).withColumnRenamed("id", "k"), 0)


@pytest.mark.parametrize("seed", [2, 3])
def test_last_words_are_what_a_fold_ends_in(spark, seed):
    """Folders whose names have one number each go without a fold; both ways end alike."""
    from types import SimpleNamespace

    f, o, e = facts(spark, seed)
    o, e = (df.withColumn("ic", F.concat(F.lit("I"), F.substring("name", 2, 9))).dropDuplicates() for df in (o, e))
    o, e = o.withColumn("race", F.substring("path", 3, 2)), e.withColumn("race", F.when(F.substring("path", 4, 1) > "4", F.substring("path", 3, 2)))
    by = {}
    for r in state.director_facts(f, o, e).collect():
        by.setdefault(r.folder, []).append(SimpleNamespace(**r.asDict() | {"at": str(r.at)}))
    want = sorted((k, key, p["name"], p.get("race", "")) for k, rs in by.items() for key, p in directors.outcome(directors._NOTHING, rs)["now"].items())
    now, _ = state.directors(f, o, e)
    assert sorted((r.folder, r.key, r.name, r.race) for r in now.collect()) == want and want


def test_days_before_the_last_profile_are_not_kept():
    """A folder's log is what can still count: from the day of its last profile on, whatever order rows come in."""
    import json

    import pandas as pd

    class Held:
        def __init__(self):
            self.d = {}

        exists = lambda self: bool(self.d)
        get = lambda self: self.d[()]
        update = lambda self, v: self.d.update({(): v})
        containsKey = lambda self, k: k in self.d
        updateValue = lambda self, k, v: self.d.update({k: v})
        removeKey = lambda self, k: self.d.pop(k)
        keys = lambda self: iter(list(self.d))
        iterator = lambda self: iter(list(self.d.items()))

    class Handle:
        def __init__(self):
            self.states = {}

        def getMapState(self, name, *_):
            return self.states.setdefault(name, Held())

        getValueState = getMapState
        registerTimer = lambda self, at: None

    row = lambda day, kind, who, n=0: {"path": f"p{day:02d}{n}", "kind": kind, "at": f"2024-01-{day:02d}", "s": 0, "q": 2, "r": "", "key": f"ID:I{who}", "name": f"N{who}", "ic": f"I{who}", **dict.fromkeys(state.OFFICER_FIELDS[2:], "")}
    every = [row(d, "APPOINT", d) for d in range(1, 29)] + [row(9, "SNAPSHOT", 40), row(20, "SNAPSHOT", 41)] + [row(20, "CEASE", 41, 1)]
    want = directors.outcome(directors._NOTHING, [directors._row(json.dumps(r)) for r in every])["now"]
    for seed in range(4):
        mixed = random.Random(seed).sample(every, len(every))
        fold, handle, told = directors.Fold(), Handle(), None
        fold.init(handle)
        for part in (mixed[:11], mixed[11:25], mixed[:11], mixed[25:]):
            frames = [pd.DataFrame(part[i : i + 4]) for i in range(0, len(part), 4)]
            for out in fold.handleInputRows(("F",), iter(frames), None):
                told = out
        assert sorted(p["key"] for p in json.loads(told["directors"][0])) == sorted(want)
        assert {v[0] for v in handle.states["log"].d.values()} == {f"2024-01-{d:02d}" for d in range(20, 29)}
