"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and bytes above 127, A-Z lowered, so case and
punctuation do not matter.  The ``SEED``-word grams of the test items are looked up
in every document in two passes over whole texts:

1. how many documents hold each gram, counted over all documents;
2. hits of one item in one document that lie within an item's length of each other
   make a passage.  It is a candidate if one of its grams is rare (in at most
   ``RARE`` of all documents) or if it has ``SEVERAL`` distinct grams of the item,
   however frequent, so a test item that leaked into very many documents is met too.
   Candidates are aligned locally with the item, word by word: ``MATCH`` for equal
   words, ``MISS`` for a changed word, ``GAP`` for one put in or left out.  The score
   is the best alignment's sum over the item's words: 1 for an exact copy.

An item of fewer than ``SEED`` words has no gram; it is held by a document that has
its words and no others, and nothing else.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, ``PASS_BLOCKS`` blocks at
a time: that is what the driver holds and what is broadcast, whatever the number of
items.  Each block's grams are counted over all documents, then one pass looks for
the blocks at hand.  Nothing is shuffled but counts of grams and the found pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import U64, Scratch, chunks, give_back, mix, small_batches, span_hashes, text_buffer, word_spans

SEED, RARE, RARE_AT_LEAST, SEVERAL = 3, 1e-3, 5, 3
MATCH, MISS, GAP = 1.0, -0.5, -0.5
#: Least score, and least number of words that an alignment's sum must reach (all words of shorter items).
THRESHOLD, LEAST_WORDS = 0.4, 6
BLOCK_WORDS, PASS_BLOCKS = 1_000_000, 2
_CELLS = 1 << 20

_NO_WORD = np.ones(256, bool)
_NO_WORD[48:58] = _NO_WORD[65:91] = _NO_WORD[97:123] = _NO_WORD[128:] = False


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and each row's first."""
    start, end, first = word_spans(raw, offsets, _NO_WORD)
    return span_hashes(raw, start, end), first


def whole_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of all words of each row that has 1 to ``SEED`` - 1 of them, 0 for any other."""
    out = np.zeros(len(first) - 1, U64)
    for n in range(1, SEED):
        at = np.flatnonzero(np.diff(first) == n)
        if len(at):
            g = np.full(len(at), n, U64)
            for k in range(n):
                g = mix(g + h[first[at] + k])
            out[at] = g | U64(1)
    return out


def grams_of(h: np.ndarray, first: np.ndarray, width: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram that begins at each word, and whether it lies within one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    g = h[:n].copy()
    for k in range(1, width):
        g = mix(g + U64(k)) + h[k : n + k]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(g), row[:n] == row[width - 1 :]


class Seeds:
    """The grams of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        texts = [(t or "").encode() for _, t in items]
        raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))]).astype(np.int64)
        h, first = words_of(raw, off)
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:])]
        # Items too short for a gram, by all their words.
        self.short: dict[int, list[int]] = {}
        for i, x in enumerate(whole_of(h, first).tolist()):
            if x:
                self.short.setdefault(x, []).append(i)
        g, ok = grams_of(h, first)
        item = np.repeat(np.arange(len(items)), np.diff(first))[: len(g)][ok]
        g = g[ok]
        order = np.lexsort((item, g))
        g, item = g[order], item[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (item[1:] != item[:-1])
        g, self.item = g[new], item[new]
        self.grams, self.first = np.unique(g, return_index=True)
        self.first = np.append(self.first, len(g))
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.grams >> U64(42)).astype(np.int64)] = True
        self.rare = np.ones(len(self.grams), bool)

    def hits(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of the rows, each row's first, the words where grams of the block begin, and which grams."""
        h, first = words_of(raw, off)
        g, ok = grams_of(h, first)
        at = np.flatnonzero(self.filter[(g >> U64(42)).astype(np.int64)] & ok) if len(self.grams) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.grams, g[at]), max(0, len(self.grams) - 1))
        same = self.grams[k] == g[at] if len(at) else np.zeros(0, bool)
        return h, first, at[same], k[same]


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment sum of ``item`` with each row of ``windows`` (padded with 0), by Smith-Waterman.

    Rows of the matrix are item words; the horizontal gap is a running maximum.
    """
    p, w = windows.shape
    slope = np.arange(w, dtype=np.float32) * np.float32(-GAP)
    h, best = np.zeros((p, w), np.float32), np.zeros(p, np.float32)
    for x in item:
        diagonal = np.zeros((p, w), np.float32)
        diagonal[:, 1:] = h[:, :-1]
        m = np.maximum(diagonal + np.where(windows == x, np.float32(MATCH), np.float32(MISS)), np.maximum(h + np.float32(GAP), 0))
        h = np.maximum.accumulate(m + slope, axis=1) - slope
        best = np.maximum(best, h.max(1))
    return best


def find(seeds: Seeds, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, item, score) of every pair that reaches the threshold, the best passage of each."""
    h, first, at, gram = seeds.hits(raw, off)
    whole = [(row, i, 1.0) for row, x in enumerate(whole_of(h, first).tolist()) if x for i in seeds.short.get(x, ())] if seeds.short else []
    if not len(at):
        return whole
    n = np.diff(seeds.first)[gram]
    item = seeds.item[np.repeat(seeds.first[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    at, gram = np.repeat(at, n), np.repeat(gram, n)
    row = np.searchsorted(first, at, "right") - 1
    size = np.array([len(w) for w in seeds.words])
    order = np.lexsort((at, item, row))
    row, item, at, gram = row[order], item[order], at[order], gram[order]
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > size[item[1:]])
    group = np.cumsum(new) - 1
    cut = np.flatnonzero(new)
    rare = np.add.reduceat(seeds.rare[gram].astype(np.int64), cut) > 0
    pair = np.unique(group * np.int64(len(seeds.grams)) + gram) // len(seeds.grams)
    distinct = np.bincount(pair, minlength=len(cut))
    # A short item has fewer grams than SEVERAL: all of them will do.
    need = np.minimum(SEVERAL, np.maximum(1, size[item[cut]] - SEED + 1))
    pick = np.flatnonzero(rare | (distinct >= need))
    if not len(pick):
        return whole
    last = np.append(cut[1:], len(at)) - 1
    r, i = row[cut[pick]], item[cut[pick]]
    a = np.maximum(at[cut[pick]] - size[i] - SEED, first[r])
    b = np.minimum(at[last[pick]] + size[i] + 2 * SEED, first[r + 1])
    best: dict[tuple[int, int], float] = {}
    order = np.lexsort((b - a, i))
    k = 0
    while k < len(order):
        j, width = k, 0
        while j < len(order) and i[order[j]] == i[order[k]]:
            width = int(b[order[j]] - a[order[j]])
            if j > k and (j - k + 1) * width > _CELLS:
                break
            j += 1
        mine = order[k:j]
        width = int((b[mine] - a[mine]).max())
        windows = np.zeros((len(mine), width), U64)
        for q, x in enumerate(mine):
            windows[q, : b[x] - a[x]] = h[a[x] : b[x]]
        m = len(seeds.words[i[mine[0]]])
        for x, s in zip(mine, align(seeds.words[i[mine[0]]], windows).tolist()):
            if s >= THRESHOLD * m and s >= min(LEAST_WORDS, m):
                key = (int(r[x]), int(i[x]))
                best[key] = max(best.get(key, 0.0), s / m)
        k = j
    return whole + [(*key, s) for key, s in sorted(best.items())]


def _blocks(items: DataFrame) -> Iterator[Seeds]:
    """The items in blocks of bounded size, each with its own id."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    words = rows.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-int(words) // BLOCK_WORDS))
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else rows.collect()
        yield Seeds(sorted((r.item_id, r.text) for r in got))


def _weighed(docs: DataFrame, seeds: Seeds) -> Seeds:
    """Marks the grams that are rare among all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        count, n = np.zeros(len(s.grams), np.int64), 0
        for b in batches:
            raw, off = text_buffer(b["text"])
            n += b.num_rows
            for _, _, r, o in chunks(raw, off):
                _, first, at, gram = s.hits(r, o)
                row = np.searchsorted(first, at, "right") - 1
                count += np.bincount(np.unique(row * np.int64(max(1, len(s.grams))) + gram) % max(1, len(s.grams)), minlength=len(s.grams))[: len(s.grams)]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(np.append(some, -1), pa.int64()), "n": pa.array(np.append(count[some], n), pa.int64())})

    held = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # one row a gram of the block
    held = {r.gram: r.n for r in held}
    limit = max(RARE_AT_LEAST, RARE * held.pop(-1, 0))
    for g, n in held.items():
        seeds.rare[g] = n <= limit
    return seeds


def _passes(docs: DataFrame, items: DataFrame) -> Iterator[list[Broadcast]]:
    """The blocks, ``PASS_BLOCKS`` at a time, all weighed by the same documents, so that their order is of no account."""
    small_batches(docs.sparkSession)
    held: list[Broadcast] = []
    for seeds in _blocks(items):
        if len(held) == PASS_BLOCKS:
            yield held
            held = []
        held.append(docs.sparkSession.sparkContext.broadcast(_weighed(docs, seeds)))
        give_back()
    yield held


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and score of every pair of a document (doc_id, text) and an item (item_id, text) it holds a copy of.

    Null and empty texts hold nothing; items that are null or have no words are held
    by nothing; items of fewer than ``SEED`` words by documents with the same words
    and no others.  Of repeated rows the best score counts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffer(b["text"])
            for i, j, r, o in chunks(raw, off):
                doc = b["doc_id"].slice(i, j - i)
                for shared in blocks:
                    found = find(shared.value, r, o)
                    if found:
                        yield pa.RecordBatch.from_arrays([doc.take(pa.array([x[0] for x in found])), pa.array([shared.value.ids[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found])], ["doc_id", "item_id", "score"])

    scratch, pairs = Scratch(docs.sparkSession, "leaks"), None
    for blocks in _passes(texts, items):
        found = scratch.keep(texts.mapInArrow(lambda b, blocks=blocks: run(b, blocks), "doc_id long, item_id long, score double"), "pairs", wide=True)
        pairs = found if pairs is None else pairs.union(found)
        for shared in blocks:
            shared.unpersist()
    return pairs.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a copy of an item (as in ``contaminated``); all columns, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffer(b["text"])
            clean = np.ones(b.num_rows, bool)
            for i, _, r, o in chunks(raw, off):
                for shared in blocks:
                    for row, _, _ in find(shared.value, r, o):
                        clean[i + row] = False
            yield b if clean.all() else b.filter(pa.array(clean))

    scratch, kept, last = Scratch(docs.sparkSession, "clean"), docs, None
    for blocks in _passes(docs, items):
        if last is not None:  # one more pass: the rows that the one before kept are written, and its blocks can go
            kept = scratch.keep(kept, "kept", wide=True)
            for shared in last:
                shared.unpersist()
        kept = kept.mapInArrow(lambda b, blocks=blocks: run(b, blocks), docs.schema)
        last = blocks
    return kept
