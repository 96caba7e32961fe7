import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from karst.llm import quality


def corpus(n=400):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 7)))
    rows = []
    for i in range(n):
        w, y = [word() for _ in range(r.randint(5, 60))], int(r.random() < 0.7)
        rows.append((i, " ".join(w) if y else " ".join(x.upper() + "!!" for x in w), y))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).withColumn("held", quality.held_out()).collect()
    y = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held]
    assert {r.doc_id for r in held} == {i for i in y if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    a = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    b = a.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    x, y = quality.fit(docs, a), quality.fit(docs, b)
    assert x[1] == y[1] and (x[0] == y[0]).all()


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (7, None), (8, 2), (None, 1), (99, 1)], "doc_id long, quality int")
    model = quality.fit(odd.select("doc_id", "text"), labels)
    out = quality.score(odd, model, "p")
    rows = out.collect()
    assert out.columns == [*odd.columns, "p"] and len(rows) == odd.count() and all(0 <= r.p <= 1 for r in rows)
    empty = {r.p for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1
    assert quality.fit(none, labels)[1] == 0.0
    assert quality.score(none, model, "p").collect() == []
    one = quality.fit(odd.select("doc_id", "text"), labels.where("quality = 1"))
    assert one[1] > 0
    both = quality.classify(odd, labels).collect()
    assert {type(r.score) for r in both} == {float} and all(r.predicted == (r.score >= 0.3) for r in both)
    assert sorted(quality.classify(odd, labels).columns) == sorted([*odd.columns, "predicted"])


def test_repeated_rows_count_once_in_the_sample(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    x, y = quality.fit(docs, labels), quality.fit(docs.union(docs).union(docs), labels)
    assert x[1] == y[1] and (x[0] == y[0]).all()


def slow_train(texts, labels, dim, epochs, rate, seed):
    """The same steps written out: dense gradients of the cross entropy by finite differences' closed form, one document at a time."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / dim, 1 / dim, (quality.BUCKETS, dim)).astype(np.float32).astype(float)
    layer = rng.normal(0, 0.1, (2, dim)).astype(np.float32).astype(float)
    bias = [0.0, 0.0]
    docs = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        docs.append(quality.features(raw, np.array([0, len(raw)]))[0].tolist())
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1 - steps / total)
            steps += 1
            mean = [sum(vectors[f][k] for f in docs[i]) / len(docs[i]) for k in range(dim)]
            z = [sum(layer[c][k] * mean[k] for k in range(dim)) + bias[c] for c in (0, 1)]
            e = [np.exp(x - max(z)) for x in z]
            g = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]
            back = [sum(g[c] * layer[c][k] for c in (0, 1)) for k in range(dim)]
            for f in docs[i]:  # a feature that is there twice moves twice as far
                for k in range(dim):
                    vectors[f][k] -= 20 * lr * back[k] / len(docs[i])
            for c in (0, 1):
                bias[c] -= 0.05 * lr * g[c]
                for k in range(dim):
                    layer[c][k] -= lr * g[c] * mean[k]
    return vectors @ (layer[1] - layer[0]), bias[1] - bias[0]


def test_gradient_steps_as_by_brute_force():
    rows = corpus(12)
    texts, labels = [r[1] for r in rows], [r[2] for r in rows]
    table, bias = quality.train(texts, labels, dim=3, epochs=2, seed=5)
    want, b = slow_train(texts, labels, 3, 2, 2.0, 5)
    used = np.unique(np.concatenate([quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]))
    assert np.allclose(table[used], want[used], atol=1e-4) and abs(bias - b) < 1e-4


def test_held_out_accuracy_on_the_test_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs.select("doc_id", "text"), labels).where(quality.held_out()).join(labels, "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    assert len(got) > 50 and right >= 0.95
