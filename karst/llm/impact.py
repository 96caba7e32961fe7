"""Ranked lexical search over a bit-sliced impact index.

The impact of a term in a document, ``SCALE tf div (1000 tf + 12 m)``, is a number
of ``BITS`` bits.  Documents are dealt into blocks, each indexed within one task,
so nothing is shuffled and no term is too frequent for a task.  For each term a
block has the places of its documents and a bitmap of every bit of their impacts.

A search adds bitmaps.  For each block the bitmaps of the asked terms are spread to
one bit for each document, and the weight of a term, the same for all documents,
is multiplied in by Horner's rule: from the highest bit of the weights down, sums
are doubled by renaming their slices, and the bitmaps of the terms that have the
bit are added with carries, for all items of a group at once.  The best documents
are found from the most significant slice down: documents with the bit set go in
while they are no more than wanted, else they alone stay candidates.

Items go in blocks of bounded size; each meets all blocks of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from karst.llm.common import PIECE, Scratch, arrow_map, chunks, gather_sums, give_back, i64, small_batches, span_hashes, text_buffer, texts_only, word_spans

U64 = np.uint64
#: Fixed by the formula of scores: 1.2 = 12 / 10 saturates term frequencies, a quarter of the length counts.
SCALE = 1_000_000_000
#: Bits of an impact, which is below SCALE / 1000.
BITS = 20
#: Documents, and about the bytes of their texts, that a block has at most (a longer text is a block of its own).
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
#: Distinct terms of items that a search holds at a time, more only if one item has more.
ITEM_TERMS = 1 << 20
#: Distinct terms whose bitmaps a task spreads at a time, and words of 64 documents that a slice of sums has.
GROUP_TERMS, GROUP_WORDS = 2048, 8192
#: Parts into which candidates of an item are dealt before the last ranking.
PARTS = 64

#: Bytes that no term has: all of ASCII but letters and digits.
_NO_TERM = np.ones(256, bool)
_NO_TERM[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _NO_TERM[_a:_b] = False


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, bytes, offsets); a row of several ``PIECE`` is cut between terms."""
    for i, _, part, off in chunks(raw, offsets):
        a = 0
        while len(off) == 2 and len(part) - a > 4 * PIECE:
            b = a + 2 * PIECE
            while b < len(part) and not (found := np.flatnonzero(_NO_TERM[part[b : b + PIECE]])).size:
                b += PIECE
            b = min(len(part), b + int(found[0])) if b < len(part) else b
            yield i, part[a:b], np.array([0, b - a])
            a = b
        yield i, part[a:], off - a if a == 0 else np.array([0, len(part) - a])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _counted(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (term, row) once, by term and row, with its sum of ``n``."""
    order = np.lexsort((row, h))
    h, row, n = h[order], row[order], n[order]
    at = _runs(h, row)
    return h[at], row[at], np.add.reduceat(n, at) if len(at) else n


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, row, tf) by term and row."""
    parts = []
    for i, part, off in _pieces(raw, offsets):
        start, end, first = word_spans(part, off, _NO_TERM)
        row = np.repeat(np.arange(i, i + len(off) - 1), np.diff(first))
        parts.append(_counted(span_hashes(part, start, end), row, np.ones(len(row), np.int64)))
    if len(parts) == 1:
        return parts[0]
    return _counted(*[np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((), (), ()))])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def part(b: pa.RecordBatch) -> list[np.ndarray]:
        raw, off = text_buffer(b["text"])
        n = np.zeros(b.num_rows, np.int64)
        for i, piece, at in _pieces(raw, off):
            n[i : i + len(at) - 1] += np.diff(word_spans(piece, at, _NO_TERM)[2])
        return [np.array([(n > 0).sum(), n.sum()])]

    found = gather_sums(docs.select("text"), part)
    return (0, 0) if found is None else (int(found[0][0]), int(found[0][1]))


def lengths_m(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A document's m, 100 - 25 + 25 n N div L, of exact integers."""
    known, at = np.unique(n, return_inverse=True)
    return np.array([75 + 25 * int(x) * docs // terms for x in known], np.int64)[at] if len(known) else n


_BLOCK = "ids array<long>, terms array<long>, counts array<int>, places binary, slices array<binary>"


class _Block:
    """The documents of a block while they come."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, ids: list[int | None], raw: np.ndarray, off: np.ndarray) -> None:
        h, row, tf = term_counts(raw, off)
        self.parts.append((h, row + len(self.ids), tf))
        self.ids += ids
        self.bytes += len(raw)

    def written(self) -> pa.RecordBatch:
        h, row, tf = _counted(*[np.concatenate(x) for x in zip(*self.parts, strict=True)])
        # Places follow doc_id, so that of equal scores the lowest place comes first.
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = np.bincount(row, tf, len(order)).astype(np.int64)
        q = SCALE * tf // (1000 * tf + 12 * lengths_m(n, self.docs, self.terms)[row])
        at = np.lexsort((place[row], h))
        h, p, q = h[at], place[row][at], q[at]
        first = _runs(h)
        slices = [np.packbits((q >> b & 1).astype(np.uint8), bitorder="little").tobytes() for b in range(BITS)]
        columns = [[[self.ids[i] for i in order]], [i64(h[first])], [np.diff(np.append(first, len(h))).astype(np.int32)], [p.astype("<u2").tobytes()], [slices]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ids", "terms", "counts", "places", "slices"])


class Index:
    """All documents (doc_id, text), in blocks, under the shared folder.

    A null text has no terms.  Every row is a document of its own, whatever its doc_id.
    """

    def __init__(self, docs: DataFrame, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES):
        assert 0 < block_docs <= 1 << 16  # places are of 16 bits
        docs = texts_only(docs, "text")
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "impact")
        self.docs, self.terms = n_docs, n_terms = corpus_size(docs)
        small_batches(self.spark)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(n_docs, max(1, n_terms))
            for b in batches:
                raw, off = text_buffer(b["text"])
                ids, i = b["doc_id"].to_pylist(), 0
                while i < len(ids):
                    fits = int(np.searchsorted(off, off[i] + block_bytes - block.bytes, "right")) - 1
                    j = max(min(fits, i + block_docs - len(block.ids), len(ids)), i if block.ids else i + 1)
                    if j > i:
                        block.add(ids[i:j], raw[off[i] : off[j]], off[i : j + 1] - off[i])
                    if j < len(ids) or len(block.ids) == block_docs:
                        yield block.written()
                    i = j
            if block.ids:
                yield block.written()
            give_back()

        self.blocks = self.scratch.keep(docs.mapInArrow(build, _BLOCK), "blocks")

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """Documents that hold each of the ascending term hashes."""

        def part(b: pa.RecordBatch) -> list[np.ndarray]:
            out = np.zeros(len(terms), np.int64)
            for held, n in zip(b["terms"], b["counts"], strict=True):
                held = held.values.to_numpy().view(U64)
                at, k = _met(held, terms)
                out[k] += n.values.to_numpy()[at]
            return [out]

        found = gather_sums(self.blocks.select("terms", "counts"), part)
        return np.zeros(len(terms), np.int64) if found is None else found[0]

    def search(self, items: DataFrame, k: int = 20, item_terms: int = ITEM_TERMS) -> DataFrame:
        """item_id, rank, doc_id, score: the ``k`` best documents of each row of items (item_id, text).

        Scores are above 0; of equal ones the lower doc_id comes first, null last.
        An item that is null, empty or has no term that a document holds gets no
        rows.  Rows of items that share an item_id are items of their own.
        """
        found = None
        for block in _item_blocks(items, item_terms):
            asked = _Asked(block, self)
            df = self.blocks.mapInArrow(lambda batches, asked=asked: asked.search(batches, k), "item int, item_id long, doc_id long, score long")
            df = self.scratch.keep(df.withColumn("block", F.lit(asked.number)), "found")
            found = df if found is None else found.union(df)
        if found is None:
            return self.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        best = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
        for by in (["block", "item", part], ["block", "item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
        return found.select("item_id", "rank", "doc_id", "score")


def _met(held: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``held`` and in ``terms``, both ascending, of what both have."""
    at = np.searchsorted(held, terms)
    k = np.flatnonzero(at < len(held))
    k = k[held[at[k]] == terms[k]]
    return at[k], k


def _item_blocks(items: DataFrame, item_terms: int) -> Iterator[list[Row]]:
    """Items as rows of (item_id, terms, counts), as many at a time as ``item_terms`` allows, one at least."""

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        h, row, tf = term_counts(*text_buffer(b["text"]))
        order = np.argsort(row, kind="stable")
        first = np.searchsorted(row[order], np.arange(b.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in (i64(h)[order], tf[order])]
        return pa.RecordBatch.from_arrays([b["item_id"], *lists], ["item_id", "terms", "counts"])

    rows = arrow_map(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), counted, "item_id long, terms array<long>, counts array<long>")
    rows = Scratch(items.sparkSession, "items").keep(rows.where(F.size("terms") > 0), "terms")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.terms) > item_terms:
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r.terms)
    if block:
        yield block


class _Asked:
    """The items of one block with their terms' weights, as they go to the tasks."""

    count = 0

    def __init__(self, items: list[Row], index: Index):
        _Asked.count += 1
        self.number = _Asked.count
        self.ids = [r.item_id for r in items]
        item = np.repeat(np.arange(len(items)), [len(r.terms) for r in items])
        terms = np.concatenate([np.array(r.terms, np.int64) for r in items]).view(U64)
        times = np.concatenate([np.array(r.counts, np.int64) for r in items])
        known, at = np.unique(terms, return_inverse=True)
        df = index.frequencies(known)
        weight = np.array([math.floor(1000 * math.log((2 * index.docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        weight = weight[at] * times
        self.item, self.term, self.weight = (x[(df[at] > 0) & (weight > 0)] for x in (item, at, weight))
        self.known = known

    def groups(self, most_items: int) -> Iterator[np.ndarray]:
        """Runs of (item, term) pairs of at most ``most_items`` items and ``GROUP_TERMS`` pairs; an item of more is a run alone."""
        first = _runs(self.item)
        ends = np.append(first, len(self.item))
        i = 0
        while i < len(first):
            j = max(i + 1, min(i + most_items, int(np.searchsorted(ends, ends[i] + GROUP_TERMS, "right")) - 1))
            yield np.arange(ends[i], ends[j])
            i = j

    def search(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                for item, score, doc, null in self._block(_Held(b.slice(i, 1)), k):
                    if item in best:
                        score, doc, null = (np.concatenate(x) for x in zip(best[item], (score, doc, null), strict=True))
                    order = np.lexsort((doc, null, -score))[:k]
                    best[item] = score[order], doc[order], null[order]
        give_back()
        if best:
            items = np.repeat(list(best), [len(v[0]) for v in best.values()])
            score, doc, null = (np.concatenate(x) for x in zip(*best.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(items.astype(np.int32)), pa.array([self.ids[i] for i in items], pa.int64()), pa.array(doc, mask=null), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    def _block(self, held: _Held, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The best documents of one block of the index: (item, scores, doc_ids, which ids are null)."""
        run, term = _met(held.terms, self.known)
        slot = np.full(len(self.known), -1)
        slot[term] = run
        for pairs in self.groups(max(1, GROUP_WORDS // held.words)):
            pairs = pairs[slot[self.term[pairs]] >= 0]
            if not len(pairs):
                continue
            items, row = np.unique(self.item[pairs], return_inverse=True)
            sums: list[np.ndarray] = []
            # One item of very many terms goes in several rounds, whose sums are added.
            for a in range(0, len(pairs), GROUP_TERMS):
                some = pairs[a : a + GROUP_TERMS]
                runs, at = np.unique(slot[self.term[some]], return_inverse=True)
                add(sums, weighted(held.spread(runs), at, row[a : a + GROUP_TERMS], self.weight[some], len(items)))
            for i, places, scores in top(sums, k):
                yield int(items[i]), scores, held.ids[places], held.null[places]


class _Held:
    """A block of the index as arrays."""

    def __init__(self, b: pa.RecordBatch):
        ids = b["ids"][0].values
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.terms = b["terms"][0].values.to_numpy().view(U64)
        self.first = np.concatenate([[0], np.cumsum(b["counts"][0].values.to_numpy(), dtype=np.int64)])
        self.places = np.frombuffer(b["places"][0].as_buffer(), "<u2")
        self.slices = [np.frombuffer(x.as_buffer(), np.uint8) for x in b["slices"][0].values]
        self.words = max(1, -(-len(self.ids) // 64))

    def spread(self, runs: np.ndarray) -> np.ndarray:
        """Bitmaps over all documents of the block, as [bit, term, word]; one term more at the end has none."""
        n = self.first[runs + 1] - self.first[runs]
        at = np.repeat(self.first[runs] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        place = self.places[at].astype(np.int64)
        cell = np.repeat(np.arange(len(runs)), n) * self.words + (place >> 6)
        shift = (place & 63).astype(U64)
        first = _runs(cell)
        out = np.zeros((BITS, len(runs) + 1, self.words), U64)
        for b, packed in enumerate(self.slices):
            bit = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            out[b].reshape(-1)[cell[first]] = np.bitwise_or.reduceat(bit.astype(U64) << shift, first)
        return out


def add(sums: list[np.ndarray], more: list[np.ndarray]) -> None:
    """Adds slices to slices, least significant first, by carries; ``sums`` grows as it must."""
    carry = None
    for b, m in enumerate(more):
        if b == len(sums):
            sums.append(np.zeros_like(m))
        s = sums[b]
        x = s ^ m
        if carry is None:
            sums[b], carry = x, s & m
        else:
            sums[b], carry = x ^ carry, (s & m) | (x & carry)
    b = len(more)
    while carry is not None and carry.any():
        if b == len(sums):
            sums.append(carry)
            break
        s = sums[b]
        sums[b], carry = s ^ carry, s & carry
        b += 1


def weighted(bitmaps: np.ndarray, term: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> list[np.ndarray]:
    """Slices of the sums over pairs (term, row) of weight times the term's numbers, one sum a row and document.

    Pairs are ascending by row.  Horner's rule over the bits of the weights.
    """
    bits, terms, words = bitmaps.shape
    sums: list[np.ndarray] = []
    for level in reversed(range(int(weight.max(initial=0)).bit_length())):
        if sums:
            sums.insert(0, np.zeros((rows, words), U64))
        on = np.flatnonzero(weight >> level & 1)
        if not len(on):
            continue
        r = row[on]
        nth = np.arange(len(on)) - np.searchsorted(r, r)
        turn = np.full((int(nth.max()) + 1, rows), terms - 1)  # the last has no bits
        turn[nth, r] = term[on]
        for chosen in turn:
            add(sums, [bitmaps[b][chosen] for b in range(bits)])
    return sums


def top(sums: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places, numbers) of the ``k`` largest numbers above 0 of each row, of equal ones the lowest places."""
    if not sums:
        return
    maybe = np.bitwise_or.reduce(sums)
    sure = np.zeros_like(maybe)
    for s in reversed(sums):
        both = maybe & s
        many = (np.bitwise_count(both).sum(1, dtype=np.int64) + np.bitwise_count(sure).sum(1, dtype=np.int64) > k)[:, None]
        sure = np.where(many, sure, sure | both)
        maybe = np.where(many, both, maybe & ~s)
    for i in range(len(maybe)):
        places, rest = (np.flatnonzero(np.unpackbits(x[i].astype("<u8").view(np.uint8), bitorder="little")) for x in (sure, maybe))
        places = np.concatenate([places, rest[: k - len(places)]])
        if len(places):
            numbers = np.zeros(len(places), np.int64)
            for b, s in enumerate(sums):
                numbers |= (s[i][places >> 6] >> (places & 63).astype(U64) & U64(1)).astype(np.int64) << b
            yield i, places, numbers
