import collections
import math
import random
import zlib

from karst.llm import lm


def brute(docs):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c, b = collections.Counter(), collections.Counter()
    for d, t in docs:
        if not held(d):
            w = tok(t)
            c.update(w)
            b.update(zip([0, *w[:-1]], w))
    n, v = sum(c.values()), len(c)

    def discounts(x):
        k = [sum(y == i for y in x) for i in range(5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0.5
        return [0, *[min(max(i - (i + 1) * y * k[i + 1] / k[i] if k[i] and k[i + 1] else i * 0.5, 0), i - 0.01) for i in (1, 2, 3)]]

    before = collections.Counter(w for _, w in b)
    d2, d1, total, rest = discounts(b.values()), discounts(before.values()), collections.Counter(), collections.Counter()
    for (a, _), k in b.items():
        total[a] += k
        rest[a] += d2[min(k, 3)]
    low = sum(d1[min(k, 3)] for k in before.values()) / len(b) if b else 1.0
    one = lambda w: max(before[w] - d1[min(before[w], 3)], 0) / max(1, len(b)) + low / (v + 1)
    two = lambda a, w: (max(b[a, w] - d2[min(b[a, w], 3)], 0) + rest[a] * one(w)) / total[a] if total[a] else one(w)
    out = []
    for d, t in docs:
        w = tok(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((d, held(d), len(w), sum(x in c for x in w), n, base, sum(math.log10(two(a, x)) for a, x in zip([0, *w[:-1]], w))))
    return out, (c, two, v)


def compare(spark, docs):
    got = lm.learn_and_score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    want = sorted(brute(docs)[0], key=key)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-6 * max(1, abs(w[6]))


def test_as_brute_force(spark):
    r = random.Random(3)
    words = ["the", "The", "of", "a", *[f"w{i}" for i in range(200)]]
    compare(spark, [(i, " ".join(r.choice(words[: r.choice([4, 20, 204])]) for _ in range(r.randint(0, 80)))) for i in range(150)])


def test_lanes_of_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm, "MOST_SHARDS", 4)
    test_as_brute_force(spark)


def test_columns_of_other_names(spark):
    docs = [(i, "a b c " * i) for i in range(20)]
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    odd = plain.selectExpr("*", "'x' as score", "1 as held_out", "text as packet", "doc_id as shard")
    assert sorted(map(tuple, lm.learn_and_score(odd).collect())) == sorted(map(tuple, lm.learn_and_score(plain).collect()))


def test_probabilities_sum_to_one():
    docs = [(0, "a b a c"), (2, "a b"), (3, "b b c")]
    _, (c, two, v) = brute(docs)
    for context in (0, b"a", b"b", b"c"):
        assert abs(sum(two(context, w) for w in c) + two(context, "unknown") - 1) < 1e-9


def test_odd_rows(spark, odd):
    compare(spark, [(r.doc_id, r.text) for r in odd.collect()])


def test_nothing_to_learn_from(spark, none):
    assert lm.learn_and_score(none).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.learn_and_score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
