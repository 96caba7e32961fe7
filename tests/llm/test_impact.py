import math
import re
from collections import Counter

import numpy as np
import pytest

from karst.llm import impact
from tests.llm.conftest import ODD

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = [(1, "One two, two THREE"), (2, "x y"), (3, None), (4, ""), (5, "nothing here is known"), (1, "漢字 😀 ünïcode im_start"), (None, "id no no"), (7, "…" * 3), (8, "one " * 3000), (9, "É é")]


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for doc, c, length in held:
            m = 75 + 25 * length * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(found[:k], 1)]
    return sorted(map(repr, out))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("limits", [{}, {"block_docs": 2}, {"block_bytes": 40}, {"block_docs": 1, "groups": 3, "item_terms": 2}])
def test_same_as_brute_force(spark, odd, monkeypatch, limits):
    item_terms, groups = limits.get("item_terms", 1000), limits.get("groups")
    if groups:
        monkeypatch.setattr(impact, "GROUP_TERMS", 1)
        monkeypatch.setattr(impact, "GROUP_WORDS", 1)
    index = impact.Index(odd, **{x: limits[x] for x in limits if x.startswith("block")})
    assert sorted(map(repr, [i for r in index.blocks.collect() for i in r.ids])) == sorted(repr(i) for i, _ in ODD)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as rank", "'a' as item", "2 as score", "3 as doc_id", "'b' as terms")
    for k in (1, 3, 20):
        assert rows(index.search(items, k, item_terms)) == brute(ODD, ITEMS, k)


def test_many_documents_with_ties(spark):
    rng = np.random.default_rng(5)
    docs = [(int(i), " ".join(f"w{j}" for j in rng.zipf(1.5, 8) if j < 60)) for i in rng.permutation(900)]
    items = [(i, " ".join(f"w{j}" for j in rng.integers(1, 60, 12))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = impact.Index(df, block_docs=130).search(spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == brute(docs, items, 20)


def test_empty_tables(spark, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert impact.Index(none).search(items).count() == 0
    assert impact.Index(spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")).search(items).count() == 0
    found = impact.Index(spark.createDataFrame(ODD, "doc_id long, text string")).search(items.limit(0))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("alpha beta " * 500 + "g" * 300 + " alpha").encode()
    raw, off = np.frombuffer(b"one alpha" + text + b"alpha", np.uint8), np.array([0, 9, 9 + len(text), 14 + len(text)])
    want = [x.tolist() for x in impact.term_counts(raw, off)]
    monkeypatch.setattr(impact, "PIECE", 16)
    monkeypatch.setattr(impact, "chunks", lambda r, o: ((i, i + 1, r[o[i] : o[i + 1]], np.array([0, o[i + 1] - o[i]])) for i in range(len(o) - 1)))
    assert len(list(impact._pieces(raw, off))) > 50
    assert [x.tolist() for x in impact.term_counts(raw, off)] == want


def test_carries_weights_and_top(monkeypatch):
    rng = np.random.default_rng(6)
    terms_, docs, rows_ = 30, 150, 7
    numbers = rng.integers(0, 1 << impact.BITS, (terms_, docs)) * (rng.random((terms_, docs)) < 0.3)
    numbers[3] = numbers[4]
    bits = np.zeros((impact.BITS, terms_ + 1, 192), np.uint8)
    for b in range(impact.BITS):
        bits[b, :terms_, :docs] = numbers >> b & 1
    maps = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
    row = np.sort(rng.integers(0, rows_, 60))
    term, weight = rng.integers(0, terms_, 60), rng.integers(1, 40000, 60)
    sums = impact.weighted(maps, term, row, weight, rows_)
    want = np.zeros((rows_, docs), np.int64)
    np.add.at(want, row, numbers[term] * weight[:, None])
    for k in (1, 5, 1000):
        got = {i: sorted(zip((-n).tolist(), p.tolist(), strict=True)) for i, p, n in impact.top(sums, k)}
        for r in range(rows_):
            best = sorted((-v, p) for p, v in enumerate(want[r].tolist()) if v > 0)[:k]
            assert got.get(r, []) == best
