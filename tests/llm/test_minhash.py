import random

import pytest

from karst.llm import minhash
from karst.llm.common import Scratch
from karst.llm.components import connected_components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(docs, width, percent):
    sets = {d: shingles(t, width) for d, t in docs if d is not None}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * either:
                a2, b2 = find(a), find(b)
                top[max(a2, b2)] = min(a2, b2)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed):
    """Random texts, exact copies, copies of edited copies around the threshold, and one large group about an original of a high id."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    docs = [[word() for _ in range(r.randint(1, 60))] for _ in range(60)]
    for _ in range(60):
        d = list(r.choice(docs))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            d[r.randrange(len(d))] = word()
        docs.append(d)
    origin = [word() for _ in range(80)]
    for _ in range(40):
        d = list(origin)
        d[r.randrange(len(d))] = word()
        d[r.randrange(len(d))] = word()
        docs.append(d)
    docs.append(origin)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_as_brute_force(spark, width, percent):
    docs = corpus(width)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, width, percent)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_blocks_of_buckets_give_the_same(spark, monkeypatch, block):
    """Stars that miss most links leave it to the blocks; great components and small ones, in blocks of few members."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    stars = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, sets, percent: stars(pairs, sets, percent).where("(u + v) % 3 = 0"))
    docs = corpus(7)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, 3, 85)


def test_a_great_group_does_not_meet_itself(spark, monkeypatch):
    """One component of many members and a few others in its buckets: copies grow with the members, not with their square."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(1, 0, i, 1, 1) for i in range(200)] + [(1, 0, 1000 + i, 1000 + i, 1) for i in range(5)]
    open_ = spark.createDataFrame(rows, "key long, band int, rep long, comp long, n long")
    got = minhash._cells(open_, Scratch(spark, "t")).collect()
    cells = {}
    for r in got:
        left, right = cells.setdefault((r.i, r.j), ([], []))
        if r.side != 1:
            left.append(r.rep)
        if r.side != 0:
            right.append(r.rep)
    met = [(u, v) for left, right in cells.values() for u in left for v in right]
    assert len(met) == len(set(met)) == 200 * 5 + 25 and not any(u < 1000 and v < 1000 for u, v in met)
    assert len(got) < 3 * len(rows)


def test_each_row_is_decided_for_itself(spark):
    a, b = "one two three four five six seven eight", "other words that nobody else has written here"
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, b, "u"), (None, b, "v"), (None, "no such thing at all in the rest", "w"), (None, "", "e"), (None, "", "f"), (1, a, "x")]
    left = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, more string"))
    assert sorted(r.more for r in left.collect()) == ["e", "f", "w", "x", "z"]
    whole = minhash.deduplicate(spark.createDataFrame([(1, a, "x"), (5, a, "y")], "doc_id long, text string, more string"))
    assert [tuple(r) for r in whole.collect()] == [(1, a, "x")]


def test_odd_rows(spark, odd):
    rows = minhash.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert [by[d].n_shingles for d in (1, 2, 3, 4, 5, 6, 8, 9)] == [0, 0, 0, 1, 1, 1, 1, 1]
    assert by[7].component_id == 6 and not by[7].kept
    assert by[1].component_id == 1 and by[2].component_id == 2
    assert by[None].component_id is None and by[None].kept
    left = minhash.deduplicate(odd, width=3, percent=85)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 10]  # of the repeated row one
    assert left.where("doc_id is null").count() == 1


def test_nothing(none):
    assert minhash.near_duplicates(none).collect() == []


def test_no_edges(spark):
    edges = spark.createDataFrame([], "u long, v long")
    assert connected_components(edges, Scratch(spark, "t")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"))
    want = {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    rows = [(r.node, r.component) for r in got.collect()]
    assert len(rows) == len(want) and dict(rows) == want
