"""Quality classifier: hashed word and character n-gram vectors, averaged, softmax, numpy SGD.

Features of a text: its words, its pairs of neighbouring words (all pairs of one
word said twice are one feature) and its byte
n-grams of 3 to 5 (none reaches over white space, but one may begin or end with
it), case kept, hashed into ``BUCKETS`` rows of a vector table.  The mean vector
goes through a softmax layer.  Vectors and layer are learned together by plain
stochastic gradient descent, one document a step, with a rate that falls
linearly, on a bounded sample of labelled documents (``sample``: those of least
hash of doc_id; the only bound, so the model costs the same at any scale).

Since the layer is linear, a trained model is one number a bucket and a bias:
scoring broadcasts those (``8 * BUCKETS`` bytes, a constant), reads whole texts
once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import _BYTE, _IS_SPACE, PIECE, U64, arrow_map, chunks, give_back, mix, span_hashes, text_buffer, word_spans

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: The feature that any word said twice in a row has in common with any other.
TWICE = U64(0x5851F42D4C957F2D)


def _blocks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every feature and the row it belongs to: words, pairs, and n-grams a piece at a time, so that a very long text takes little memory."""
    mask = U64(BUCKETS - 1)
    start, end, first = word_spans(raw, offsets)
    h = span_hashes(raw, start, end, lower=False)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    yield (h & mask).astype(np.int64), row
    if len(h) > 1:
        same = row[1:] == row[:-1]
        pair = np.where(h[:-1] == h[1:], TWICE, mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]))
        yield (pair[same] & mask).astype(np.int64), row[1:][same]
    for a in range(0, len(raw), PIECE):
        part = raw[a : a + PIECE + max(SIZES) - 1]
        byte, n = _BYTE[part], len(part)
        spaces = np.concatenate([[0], np.cumsum(_IS_SPACE[part])])
        # The row of each byte: how many rows begin up to it.
        begins = np.bincount(offsets[(offsets > a) & (offsets < a + n)] - a, minlength=n)
        owner = int(np.searchsorted(offsets, a, "right")) - 1 + np.cumsum(begins)
        for size in SIZES:
            m = min(PIECE, n - size + 1)
            if m <= 0:
                continue
            g = byte[:m].copy()
            for k in range(1, size):
                g *= U64(0x100000001B3)
                g += byte[k : m + k]
            ok = (owner[:m] == owner[size - 1 : m + size - 1]) & (spaces[size - 1 : m + size - 1] == spaces[1 : m + 1])
            yield (mix(g[ok] + U64(size)) & mask).astype(np.int64), owner[:m][ok]


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature, and the row it belongs to."""
    ids, rows = zip(*_blocks(raw, offsets))
    return np.concatenate(ids), np.concatenate(rows)


def train(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 2.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """The learned table, as one log-odds number a bucket, and the bias.

    Where all examples are of one class every score says so (0.98 or 0.02); without any it is 0.5.
    """
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), (0.0 if not labels else 4.0 if labels[0] else -4.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    layer[:] = rng.normal(0, 0.1, (2, dim))
    docs = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        ids, _ = features(b, np.array([0, len(b)]))
        u, c = np.unique(ids, return_counts=True)
        # Counts in as few bytes as they need: these arrays are most of what the driver holds.
        docs.append((u.astype(np.int32), c.astype(np.min_scalar_type(int(c.max(initial=0)))), max(1, len(ids))))
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = np.float32(rate * (1 - steps / total))
            steps += 1
            u, c, n = docs[i]
            c = (c / n).astype(np.float32)
            v = vectors[u]
            x = c @ v
            z = layer @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            vectors[u] = v - np.outer(c, (lr * 20) * (p @ layer))
            layer -= lr * np.outer(p, x)
            bias -= lr * 0.05 * p
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def _scores(table: np.ndarray, bias: float, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.empty(len(offsets) - 1)
    for i, j, r, o in chunks(raw, offsets, 1 << 19):
        n, z = np.zeros(j - i, np.int64), np.zeros(j - i)
        for ids, row in _blocks(r, o):
            n += np.bincount(row, minlength=j - i)
            z += np.bincount(row, weights=table[ids], minlength=j - i)
        z = z / np.maximum(n, 1) + bias
        out[i:j] = 1 / (1 + np.exp(-z))
    return out


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000) -> tuple[np.ndarray, float]:
    """A model from rows of ``labels`` (doc_id, label 0 or 1) that are not held out.

    ``sample`` bounds the rows; they are the least by hash of doc_id.  Labels that
    are null or neither 0 nor 1, and doc_ids without a document, teach nothing; of
    several labels for one doc_id the least counts, and of several texts.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"))
    lab = lab.select(F.col("doc_id").cast("long").alias("id"), "y").orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` rows of 12 bytes: a proven bound for the broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(lab), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted((r.id, r.text or "", r.y) for r in rows)
    model = train([r[1] for r in rows], [r[2] for r in rows])
    del rows
    give_back()  # the driver lives on
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability of label 1, 0 to 1.

    A null, empty or white text has no features and gets the bias alone.  All
    columns stay, but one of the name ``out`` gives way; one row in, one row out.
    """
    docs = docs.drop(out)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = text_buffer(b.column(b.schema.get_field_index("text")))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(_scores(*shared.value, raw, off))], [*b.schema.names, out])

    schema = type(docs.schema)(list(docs.schema.fields)).add(out, "double")
    return arrow_map(docs, f, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` with score and predicted (1 if score >= threshold).  Columns of these names give way."""
    return score(docs, fit(docs, labels, **options)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
