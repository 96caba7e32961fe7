import random

import numpy as np

from karst.llm import decontaminate as D


def slow(item, window):
    best, h = 0.0, [[0.0] * (len(window) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(window, 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (D.MATCH if x == y else D.MISS), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    r = random.Random(1)
    for _ in range(60):
        item = np.array([r.randrange(1, 6) for _ in range(r.randint(1, 15))], np.uint64)
        windows = np.array([[r.randrange(1, 6) for _ in range(20)] for _ in range(3)], np.uint64)
        assert np.allclose(D.align(item, windows), [slow(item.tolist(), w.tolist()) for w in windows])


def planted(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(r.randint(15, 50)))) for i in range(20)]
    docs, want = [], set()
    for d in range(200):
        host = text(r.randint(20, 200))
        if d % 4 == 0:
            i = r.randrange(20)
            w = items[i][1].split()
            for _ in range(len(w) // 6 if d % 8 else 0):  # every other copy is edited
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [word()], [w[k], word()]])
            if d % 12 == 0:
                w = [x.upper() + "," for x in w]
            at = r.randrange(len(host))
            host[at:at] = w
            want.add((d, i))
        docs.append((d, " ".join(host)))
    return docs, items, want


def test_copies_are_found_and_clean_documents_left(spark):
    docs, items, want = planted(spark)
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(a, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.score for r in got if r.doc_id % 8 == 0} == {1.0}
    assert {r.doc_id for r in D.decontaminate(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, want = planted(spark)
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_short_items_by_exact_match(spark):
    docs = [(1, "Yes!"), (2, "yes, it is"), (3, "the end"), (4, "The End."), (5, "end the"), (6, "yes yes"), (6, "YES")]
    items = spark.createDataFrame([(1, "yes"), (2, "the end"), (3, "!!"), (4, "yes")], "item_id long, text string")
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {tuple(r) for r in got} == {(1, 1, 1.0), (1, 4, 1.0), (3, 2, 1.0), (4, 2, 1.0), (6, 1, 1.0), (6, 4, 1.0)}


def test_the_order_of_blocks_is_of_no_account(spark, monkeypatch):
    """What is rare is counted over all documents, not over those that an earlier block has left."""
    docs, items, want = planted(spark)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_WORDS", 100)
    seen, weighed = [], D._weighed
    monkeypatch.setattr(D, "_weighed", lambda d, s: seen.append(d) or weighed(d, s))
    assert {r.doc_id for r in D.decontaminate(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert len(seen) > 3 and all(d is a for d in seen)


def test_an_item_that_leaked_everywhere(spark):
    docs = [(i, f"w{i} alpha beta gamma delta epsilon zeta eta theta x{i}") for i in range(300)]
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta")]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.count() == 300


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "one two three"), (None, "x x x"), (5, "x x x x x x x x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(odd, items).collect()}
    assert got == {(5, 3), (6, 4), (7, 4), (8, 5)}  # an item of two words is held by the document that is it
    left = D.decontaminate(odd, items)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 9, 10]
    assert D.contaminated(none, items).collect() == [] and D.decontaminate(none, items).collect() == []
    assert D.contaminated(odd, items.limit(0)).collect() == [] and D.decontaminate(odd, items.limit(0)).count() == odd.count()
