import random

import numpy as np
import pytest

from karst.llm import hamming


def brute(rows, queries, k):
    bits = lambda v: [x is not None and x >= 0 for x in v]
    out = set()
    for q, a in queries:
        near = {}
        for i, b in rows:
            d = sum(x != y for x, y in zip(bits(a), bits(b)))
            near[i] = min(d, near.get(i, 99))
        out |= {(q, n, i, d) for n, (d, i) in enumerate(sorted((d, i) for i, d in near.items())[:k], 1)}
    return out


@pytest.mark.parametrize("close", [True, False])
def test_as_brute_force(spark, close):
    r = random.Random(8)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    vector = lambda: [x + r.uniform(-0.5, 0.5) for x in r.choice(centres)] if close else [r.uniform(-1, 1) for _ in range(64)]
    rows = [(i, vector()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one very frequent vector
    df = spark.createDataFrame(rows, "vec_id long, e array<float>")
    got = hamming.top_k(df, df.where("vec_id % 20 = 0"), "vec_id", "e", k=7)
    assert {tuple(x) for x in got.collect()} == brute(rows, [x for x in rows if x[0] % 20 == 0], 7)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(hamming, "DATA_BLOCK", 50)
    test_as_brute_force(spark, True)


def index_of(ids, code, k):
    return hamming.Index(hamming.tables(ids, code, k).__getitem__, k)


def test_a_run_carries_the_bound(spark, monkeypatch):
    monkeypatch.setattr(hamming, "DATA_BLOCK", 20)
    monkeypatch.setattr(hamming, "RUN", 4)
    monkeypatch.setattr(hamming, "QUERY_SLICE", 8)
    test_as_brute_force(spark, False)


@pytest.mark.parametrize("n", [1, 3, 30, 2000, 20000])
def test_index_is_exact(n):
    r = np.random.Generator(np.random.PCG64(1))
    for words in (1, 2):
        code = r.integers(0, 2**64, (n, words), dtype=np.uint64)
        code[n // 2 :] = code[: n - n // 2] ^ (np.uint64(1) << r.integers(0, 64, (n - n // 2, words), dtype=np.uint64))  # near pairs
        index = index_of(np.arange(n), code, 5)
        for q in range(min(n, 20)):
            ids, d = index.nearest(code[q])
            all_ = np.bitwise_count(code ^ code[q]).sum(1).astype(int)
            order = np.lexsort((np.arange(n), all_))[:5]
            assert ids.tolist() == order.tolist() and d.tolist() == all_[order].tolist()
            few, near = index.nearest(code[q], int(d[0]) + 1)
            assert near.tolist() == [x for x in d.tolist() if x <= d[0] + 1] and few.tolist() == ids.tolist()[: len(few)]


def test_fewer_codes_are_met_than_stored():
    """100,000 random codes, the hardest case: the tables prove the ten nearest from a part of them."""
    r = np.random.Generator(np.random.PCG64(1))
    n = 100_000
    code = r.integers(0, 2**64, (n, 1), dtype=np.uint64)
    index = index_of(np.arange(n), code, 10)
    assert index.segments == 4 and all(len(s) == (1 << 16) + 1 for s in index.start)
    for q in range(20):
        index.nearest(code[q])
    assert index.asked == 20 and index.verified < 0.2 * n * index.asked and index.radii < 20 * 6
    # Where neighbours are near, next to nothing is met.
    near = index_of(np.arange(n), np.repeat(code[: n // 20], 20, 0) ^ (np.uint64(1) << (np.arange(n, dtype=np.uint64) % np.uint64(20)))[:, None], 10)
    for q in range(20):
        near.nearest(code[q])
    assert near.verified < 0.002 * n * near.asked


def test_the_queries_on_the_test_tables_use_the_index():
    import duckdb

    v = np.array(duckdb.sql("SELECT embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchnumpy()["embedding"].tolist())
    code = np.packbits(v >= 0, axis=1, bitorder="little").view(np.uint64).reshape(len(v), -1)
    index = index_of(np.arange(len(code)), code, 10)
    for q in range(0, len(code), 20):
        index.nearest(code[q])
    assert index.verified < len(code) * index.asked


def test_odd_rows(spark):
    v = [1.0] * 64
    rows = [(1, v), (1, v), (2, None), (None, v), (3, [1.0]), (4, [None, float("nan"), *v[2:]]), (5, [-x for x in v])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>")
    got = hamming.top_k(df, df, "vec_id", "e", k=10).collect()
    assert {(r.query_id, r.rank, r.id, r.distance) for r in got if r.query_id == 1} == {(1, 1, 1, 0), (1, 2, 4, 2), (1, 3, 5, 64)}
    assert {r.query_id for r in got} == {1, 4, 5}
    assert hamming.top_k(df.limit(0), df, "vec_id", "e").collect() == hamming.top_k(df, df.limit(0), "vec_id", "e").collect() == []
