"""Token ids in grammar-compressed shards (Re-Pair).

Documents are dealt by range of doc_id, encoded, and packed into shards of about
``SHARD`` ids.  In a shard the frequent pairs of neighbouring symbols are replaced
by new symbols (nonterminals), round by round, until no pair is frequent; no pair
reaches over a document's end.  All pairs of the shard are counted, and none by bins.

A shard is one binary value:

    "KRP2", 6 x uint32 (documents, rules, symbols, bytes a symbol, first rule's symbol,
    documents without doc_id, which come first),
    doc_id int64[documents], first symbol uint32[documents + 1], first id uint32[documents + 1],
    left and right side of each rule, expansion length uint32[rules], the symbols

so one document, or any range of ids in it, is decoded without the rest: the
expansion lengths tell which symbols reach into the range.  Shards are rows of a
Parquet table (part, seq, first doc, ids, shard) under the shared folder; their
order is (part, seq), and it is the order of doc_id, nulls first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.common import U64, Scratch, chunks, give_back, small_batches, text_buffer, texts_only

MAGIC = b"KRP2"
#: Ids of a shard (a longer document stays whole), pairs of a round at most, least count of a pair.
SHARD, PER_ROUND, LEAST = 2_000_000, 4000, 24
_BINS = 18
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[9, 10, 13]] = 32
_LOWER = _BLANK.copy()
_LOWER[65:91] += 32
#: 1 for letters and digits, 2 for punctuation but the apostrophe, 0 for other bytes.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[i for i in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)] if i != 39]] = 2


# --- encoding ----------------------------------------------------------------


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct word of a worker once.

    The tokenizer must treat ASCII blanks as separators only (``word_bpe``: its
    pre-tokens hold no white space), so a text's ids are those of its words, one
    after another, and a word's those of its pre-tokens.  A-Z may be lowered beforehand
    where no combining character could join with them and no special token could come
    into being.
    """

    MOST = 700_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        marks = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))]
        spans, start = [], marks[0]
        for a, b in zip(marks, [*marks[1:], -1]):
            if b != a + 1:
                spans.append(f"{chr(start)}-{chr(a)}")
                start = b
        self.unsafe = re.compile(f"[{''.join(spans)}]")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ",."}
        if any(len(self.tokenizer.encode(f"a{m}", add_special_tokens=False).ids) != 2 for m in self.marks):
            raise ValueError("a comma or stop after a letter is no token of its own")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _plain(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes, all white space that separates as blanks, and A-Z lowered in each text that allows it; and where units end.

        A unit is a word with the blank behind it, or a part of a word: pre-tokens end
        between letters or digits and punctuation, wherever that is seen in ASCII and
        Latin-1.  An apostrophe may begin a contraction, so no unit ends beside one.
        """
        rows = lambda at: np.unique(np.searchsorted(off, at, "right") - 1)
        special = rows(np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))) if len(raw) else np.zeros(0, np.int64)
        # Combining characters begin at U+0300, and so with a byte of 0xCC or more.
        unsafe = [i for i in rows(np.flatnonzero(raw >= 0xCC)) if self.unsafe.search(raw[off[i] : off[i + 1]].tobytes().decode())]
        out = _LOWER[raw]
        for i in [*special.tolist(), *unsafe]:
            out[off[i] : off[i + 1]] = _BLANK[raw[off[i] : off[i + 1]]]
        ends = np.ones(len(raw) + 1, bool)
        if len(raw):
            first, last = _KIND[out], _KIND[out]
            letter = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] != 0x97) & (out[1:] != 0xB7))
            first[letter], last[letter + 1] = 1, 1
            ends[1:-1] = (last[:-1] ^ first[1:]) == 3  # 1 before 2, or 2 before 1
            for i in special.tolist():
                ends[off[i] : off[i + 1]] = False
            ends[1:] |= out == 32
            ends[off] = True
        return out, np.flatnonzero(ends)

    def _learn(self, words: list[str]) -> None:
        """Words of letters are encoded many to a text and told apart by the tokens that end a pre-token.

        A word of letters with one final comma or stop has the ids of both parts; all other words are encoded one by one.
        """
        plain, marked, hard = set(), [], []
        # Lowered, as a letter may become several characters of which one is none.
        for w in words:
            if w.lower().isalpha():
                plain.add(w)
            elif w[-1:] in (",", ".") and w[:-1].lower().isalpha():
                marked.append(w)
                if w[:-1] not in self.known:
                    plain.add(w[:-1])
            else:
                hard.append(w)
        easy = list(plain)
        texts = [" ".join(easy[i : i + 256]) for i in range(0, len(easy), 256)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) == len(easy):
            self._add(easy, ids, np.diff(np.concatenate([[0], stops])))
            if marked:
                base = np.fromiter((self.known[w[:-1]] for w in marked), np.int64, len(marked))
                size = self.size[base]
                upto = np.cumsum(size + 1)
                out = np.empty(int(upto[-1]), np.uint32)
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out[np.repeat(upto - size - 1, size) + within] = self.ids[np.repeat(self.start[base], size) + within]
                out[upto - 1] = [self.marks[w[-1]] for w in marked]
                self._add(marked, out, size + 1)
        else:
            hard = words
        if hard:
            enc = [e.ids for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)]
            self._add(hard, np.array([i for e in enc for i in e], np.uint32), np.fromiter(map(len, enc), np.int64, len(enc)))

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        first = len(self.ids) + np.cumsum(size) - size
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words))))
        self.ids = np.concatenate([self.ids, ids])
        self.start, self.size = np.concatenate([self.start, first]), np.concatenate([self.size, size])

    def encode(self, texts: pa.Array | list[str | None], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each begins (one more at the end)."""
        if len(self.known) > self.MOST:
            self.clear()
        raw, off = text_buffer(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, cuts = self._plain(raw, off)
        # Units lie one after another, so Arrow tells them apart where they stand.
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        words = [w.rstrip(" ") for w in coded.dictionary.to_pylist()]
        known = self.known
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            mine = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(mine)))
            at[new] = np.fromiter(map(known.__getitem__, mine), np.int32, len(mine))
        at = at[coded.indices.to_numpy()]
        size = self.size[at]
        upto = np.concatenate([[0], np.cumsum(size)])
        kind = np.int32 if upto[-1] < 2**31 else np.int64
        ids = self.ids[np.repeat((self.start[at] - upto[:-1]).astype(kind), size) + np.arange(upto[-1], dtype=kind)]
        cuts = upto[np.searchsorted(cuts, off)]
        if end is None:
            return ids, cuts
        return np.insert(ids, cuts[1:], end), cuts + np.arange(len(cuts))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- grammar -----------------------------------------------------------------


def compress(ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where each document's begin, and both sides of the rules; rule i is symbol ``base + i``.

    Every pair is counted exactly: by sorting all of them at first, and later those
    alone that can be frequent, as a pair that was rare becomes so only by a new symbol.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    seq, cuts = ids.astype(np.uint32), cuts.astype(np.int64)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rules = 0
    live = np.ones(len(seq), bool)  # whether a symbol and the next one may be a frequent pair
    while True:
        live[cuts[1:][cuts[1:] > 0] - 1] = False  # a document's last symbol and the next one are no pair
        at = np.flatnonzero(live)
        if len(at) < LEAST:
            break
        kind, shift = (np.uint32, 16) if base + rules <= 1 << 16 else (U64, 32)
        key = (seq[at].astype(kind) << kind(shift)) | seq[at + 1]
        pairs, count = _counted(key)
        often = count >= LEAST
        pairs, count = pairs[often], count[often]
        if not len(pairs):
            break
        place = _places(key, pairs)
        live[at[place < 0]] = False
        rule = np.full(len(pairs) + 1, -1, np.int64)  # one more, for place -1
        top = np.argsort(-count, kind="stable")[:PER_ROUND]
        rule[top] = base + rules + np.arange(len(top))
        new = rule[place]
        some = new >= 0
        hit, new = at[some], new[some]
        # Of hits side by side every second one is taken, from the left.
        here = np.arange(len(hit))
        run = np.zeros(len(hit), np.int64)
        fresh = np.flatnonzero(np.diff(hit) != 1) + 1
        run[fresh] = fresh
        take = (here - np.maximum.accumulate(run)) % 2 == 0
        hit, new = hit[take], new[take]
        left.append((pairs[top] >> kind(shift)).astype(np.int64))
        right.append((pairs[top] & kind((1 << shift) - 1)).astype(np.int64))
        rules += len(top)
        seq[hit] = new
        live[hit] = True
        live[np.maximum(hit - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        cuts -= np.searchsorted(hit + 1, cuts)
        seq, live = seq[keep], live[keep]
    z = np.zeros(0, np.int64)
    return seq, cuts, np.concatenate([z, *left]), np.concatenate([z, *right])


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there."""
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.diff(np.append(first, len(key)))


def _places(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The index in ``some``, which is in order, of each key, -1 if it is not there."""
    kind, bits = (np.uint32, 32) if key.dtype == np.uint32 else (U64, 64)
    bin_ = lambda x: (x * kind(0x9E3779B1 if bits == 32 else 0x9E3779B97F4A7C15)) >> kind(bits - _BINS)
    held = np.full(1 << _BINS, -1, np.int32)
    held[bin_(some)] = np.arange(len(some))
    out = held[bin_(key)]
    odd = np.flatnonzero(out >= 0)
    odd = odd[some[out[odd]] != key[odd]]  # in the bin of another one
    if len(odd):
        near = np.minimum(np.searchsorted(some, key[odd]), len(some) - 1)
        out[odd] = np.where(some[near] == key[odd], near, -1)
    return out


def lengths(base: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Length of every rule's expansion, and the rules in an order in which each names earlier ones only."""
    n = len(left)
    size = np.zeros(n, np.int64)
    one = lambda s: np.where(s < base, 1, size[np.maximum(s - base, 0)])
    todo = np.arange(n)
    level = []
    while len(todo):  # rules name earlier rules only
        a, b = one(left[todo]), one(right[todo])
        ok = (a > 0) & (b > 0)
        size[todo[ok]] = (a + b)[ok]
        level.append(todo[ok])
        todo = todo[~ok]
    return size, level


def expansions(base: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of every rule's expansion, where it begins in the list of all, and that list."""
    size, level = lengths(base, left, right)
    one = lambda s: np.where(s < base, 1, size[np.maximum(s - base, 0)])
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint32)
    for rules in level:
        for side, shift in ((left[rules], np.zeros(len(rules), np.int64)), (right[rules], one(left[rules]))):
            width = one(side)
            to = np.repeat(start[rules] + shift - (np.cumsum(width) - width), width) + np.arange(width.sum())
            plain = side < base
            source = np.where(plain, 0, start[np.maximum(side - base, 0)])
            got = flat[np.repeat(source - (np.cumsum(width) - width), width) + np.arange(width.sum())]
            flat[to] = np.where(np.repeat(plain, width), np.repeat(side, width), got)
    return size, start, flat


def pack(docs: np.ndarray, ids: np.ndarray, cuts: np.ndarray, nulls: int = 0) -> bytes:
    seq, at, left, right = compress(ids, cuts)
    base = int(ids.max()) + 1 if len(ids) else 0
    wide = base + len(left) > 65535
    kind = np.uint32 if wide else np.uint16
    size, _ = lengths(base, left, right)
    head = np.array([len(docs), len(left), len(seq), 4 if wide else 2, base, nulls], np.uint32)
    return b"".join([MAGIC, head.tobytes(), docs.astype(np.int64).tobytes(), at.astype(np.uint32).tobytes(), cuts.astype(np.uint32).tobytes(), left.astype(kind).tobytes(), right.astype(kind).tobytes(), size.astype(np.uint32).tobytes(), seq.astype(kind).tobytes()])


class Shard:
    """A reader of one shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        d, r, s, width, self.base, self.nulls = (int(x) for x in np.frombuffer(blob, np.uint32, 6, 4))
        kind, at = np.uint32 if width == 4 else np.uint16, 28
        take = []
        for k, n in ((np.int64, d), (np.uint32, d + 1), (np.uint32, d + 1), (kind, r), (kind, r), (np.uint32, r), (kind, s)):
            take.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
        self.docs, self.at, self.cuts, left, right, self.size, self.seq = take
        _, self.start, self.flat = expansions(self.base, left.astype(np.int64), right.astype(np.int64))

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        seq = seq.astype(np.int64)
        plain = seq < self.base
        if not len(self.size):
            return seq.astype(np.uint32)
        rule = np.maximum(seq - self.base, 0)
        width = np.where(plain, 1, self.size[rule].astype(np.int64))
        source = np.where(plain, 0, self.start[rule])
        got = self.flat[np.repeat(source - (np.cumsum(width) - width), width) + np.arange(width.sum())]
        single = np.cumsum(width)[plain] - 1
        got[single] = seq[plain]
        return got

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document i; only the symbols that reach into them are expanded."""
        seq = self.seq[self.at[i] : self.at[i + 1]]
        upto = np.cumsum(np.where(seq < self.base, 1, self.size[np.maximum(seq.astype(np.int64) - self.base, 0)] if len(self.size) else 1))
        stop = int(upto[-1]) if stop is None and len(upto) else stop or 0
        a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left") + 1
        skip = int(upto[a - 1]) if a else 0
        return self._expand(seq[a:b])[start - skip : stop - skip]


# --- tables ------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str, end: int | None, scratch: Scratch, encoder_of: Callable[[str], WordEncoder] = encoder) -> DataFrame:
    """The table of shards of all ``docs`` (doc_id, text).

    Null text is empty, so such a document has the end id alone.  Rows go by doc_id, nulls first,
    then text; repeated rows stay.  One shuffle, of the texts, by range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            ids, cuts = np.concatenate([i for _, i, _ in held]), np.concatenate([[0], *[c[1:] + s for (_, _, c), s in zip(held, np.cumsum([0, *[len(i) for _, i, _ in held]]))]])
            own = pa.chunked_array([d for d, _, _ in held])
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(own)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "shard": pa.array([pack(own.fill_null(0).to_numpy(), ids, cuts, own.null_count)], pa.binary())})

        for b in batches:
            for i, j, _, _ in chunks(*text_buffer(b["text"]), 3 << 20):
                x = b.slice(i, j - i)
                ids, cuts = encoder_of(tokenizer).encode(x["text"], end)
                held.append((x["doc_id"], ids, cuts))
                n += len(ids)
                if n >= SHARD:
                    yield out()
                    seq, held, n = seq + 1, [], 0
        if held:
            yield out()
        held = []
        give_back()

    small_batches(docs.sparkSession)
    rows = texts_only(docs, "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.keep(rows.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, shard binary"), "shards", "uncompressed", wide=True)


def read_shards(shards: DataFrame) -> DataFrame:
    """What the shards hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Shard totals are summed within a part by a window and over the parts on the
    driver: one number a part, so the driver holds no more than there are tasks.
    """
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    spark, base, rows = shards.sparkSession, 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    before = spark.createDataFrame(rows, "part int, base long")
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("inner"))
    places = places.join(F.broadcast(before), "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, blob in zip(b["base"].to_pylist(), b["shard"].to_pylist()):
                s = Shard(blob)
                ids = s.ids().astype("<u4")
                cuts = s.cuts.astype(np.int64)
                if len(ids) != cuts[-1]:
                    raise ValueError("a shard's ids don't match its lengths")
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.docs, mask=np.arange(len(s.docs)) < s.nulls), "start": pa.array(cuts[:-1] + base), "n_tokens": pa.array(np.diff(cuts)), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.select("part", "seq", "shard").join(places, ["part", "seq"]).select("base", "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
