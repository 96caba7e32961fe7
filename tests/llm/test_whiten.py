import math

import numpy as np
import pytest

from karst.llm import whiten


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>")


def brute(rows, k):
    """All components by a dense eigendecomposition; rows that take part by the contract's words."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    s = [sum(x[j] for _, x in kept) for j in range(d)]
    y = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for _, x in kept])
    e, v = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:k]
    z = y @ v[:, order] / np.sqrt(e[order])
    deviation = [sum((n * x[j] - s[j]) ** 2 for j in range(d)) for _, x in kept]
    return [i for i, _ in kept], n, deviation, z, e[order] / e.sum()


def same(got, rows, k):
    keys, n, deviation, z, part = brute(rows, k)
    assert len(got) == len(keys) * z.shape[1]
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c, found in by.items():
        found.sort(key=lambda r: (r.vec_id is None, r.vec_id))
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i]))
        want = z[order, c - 1]
        have = np.array([r.whitened for r in found])
        sign = np.sign(have @ want)
        assert np.abs(sign * have - want).max() < 1e-7 and abs(found[0].explained / part[c - 1] - 1) < 1e-9
        assert [r.vec_id for r in found] == [keys[i] for i in order] and [r.deviation for r in found] == [deviation[i] for i in order]
        assert {r.n for r in found} == {n} and {r.identity_error for r in found} == {got[0].identity_error} and got[0].identity_error < 1e-8


@pytest.mark.parametrize("shape", ["flat", "falling", "one strong"])
def test_same_as_dense(spark, shape):
    rng = np.random.default_rng(3)
    scale = {"flat": np.ones(24), "falling": 0.6 ** np.arange(24), "one strong": np.r_[30, np.ones(23)]}[shape]
    data = [(i, list(v * 3 + 1)) for i, v in enumerate(rng.standard_normal((400, 24)) * scale)]
    data += [(400, None), (401, []), (402, [None] * 24), (403, [float("nan")] + [0.0] * 23), (404, [float("inf")] + [0.0] * 23)]
    df = table(spark, data).selectExpr("*", "1 as x", "2 as n", "'a' as key", "0 as component")
    same(whiten.whiten(df, "vec_id", "embedding").collect(), data, 8)


def test_the_block_stays_narrow_where_eigenvalues_fall(spark):
    rng = np.random.default_rng(4)
    for scale, narrow in ((0.5 ** np.arange(64), True), (np.ones(64), False)):
        x = whiten.vectors(table(spark, list(enumerate((rng.standard_normal((300, 64)) * scale * 50).tolist()))), "vec_id", "embedding")
        n, sums = whiten.moments(x)
        found = whiten.fit(x, n, sums, 8)
        assert (found.width == 16) == narrow and found.passes < 40
        dense = whiten.multiply(x, n, sums, np.eye(64))[0]
        assert np.linalg.norm(dense @ found.axes - found.axes * found.values, axis=0).max() < 1e-9 * found.values[0]
        assert np.abs(found.axes.T @ found.axes - np.eye(8)).max() < 1e-12


def test_few_dimensions_equal_rows_and_repeated_keys(spark):
    two = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (3, [-2.5, 4.0])]
    same(whiten.whiten(table(spark, two), "vec_id", "embedding").collect(), two, 8)
    equal = whiten.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), "vec_id", "embedding").collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in equal] == [(c, 2, 0, None, None, None) for c in (1, 2, 1, 2)]
    line = whiten.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(5)]), "vec_id", "embedding").collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12


def test_lengths_and_huge_entries(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0, 2.0, 3.0])]
    assert {r.vec_id for r in whiten.whiten(table(spark, rows), "vec_id", "embedding").collect()} == {1, 2}
    huge = whiten.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, 5.0])]), "vec_id", "embedding").collect()
    assert {r.deviation for r in huge if r.vec_id == 1} == {None} and huge[0].identity_error < 1e-6


def test_empty(spark):
    assert whiten.whiten(table(spark, []), "vec_id", "embedding").collect() == []
    assert whiten.whiten(table(spark, [(1, None)]), "vec_id", "embedding").columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
