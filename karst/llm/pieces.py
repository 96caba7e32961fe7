"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is cut where no merge can reach over: before a run of blanks and around
line ends (checked against the vocabulary when it is loaded).  In each segment an
agenda of candidate merges is worked off, best score first, leftmost first.  A
candidate is skipped for good if a keyed hash of (seed, doc_id, the segment's
place in the document, start, middle, end) falls below ``dropout``.  So every
occurrence of a word is drawn for itself, the same seed gives the same ids in any
order and on any machine, other seeds give other segmentations, and dropout 0
gives the library's own ids.

What is kept between occurrences is no draw: a node is a word with the candidates
that are skipped in it, what its agenda makes of it if nothing else is skipped,
and the candidates met there for the first time.  An occurrence draws for those,
and goes on to the node that has the skipped ones too, until it skips none.  A node
is made when it is asked for again; until then the agenda is worked off with the
occurrence's own draws, which gives the same ids.

Characters outside the vocabulary become byte pieces, and so does a U+2581 that
stands in the text itself, as its piece means a blank; every text comes back whole.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.common import U64, arrow_map, mix, text_buffer

BLANK = "▁"
DROPOUT, SEED = 0.1, 17
#: Longer segments go through a heap, one by one; shorter ones are merged many at a time.
LONG = 64
#: Segments with more candidates at a node are worked off for each occurrence, without nodes.
MOST_MET = 31
NONE = np.int64(1) << 40


class Pieces:
    """A BPE vocabulary of a SentencePiece model file."""

    MOST = 1_000_000

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        plain: dict[str, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(p[3:5], 16)])
                self.byte_id[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[p] = i
                self.bytes[i] = p.replace(BLANK, " ").encode()
        if any("\n" in p and len(p) > 1 or BLANK in p.lstrip(BLANK) for p in plain):
            raise ValueError("a piece reaches over a blank or a line end")
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[32], self.char[ord(BLANK)] = self.char[ord(BLANK)], -1
        # Rank of a piece: its place by falling score; equal scores share one, so position decides.
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.searchsorted(np.unique(-score), -score).astype(np.int64)
        pair = {(plain[p[:k]], plain[p[k:]]): i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        self.merge = pair
        keys = np.array([(a << 20) | b for a, b in pair], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(pair.values()), np.int64)[order]
        # One merge of each bin is found at once, the others of a crowded bin by search.
        self.held = np.zeros(1 << 20, np.int32)
        self.held[self._bin(self.keys)] = np.arange(len(self.keys))
        self.crowded = np.bincount(self._bin(self.keys).astype(np.int64), minlength=1 << 20) > 1
        self.clear()

    def clear(self) -> None:
        z = np.zeros(0, np.int64)
        #: Nodes: by word, and by node and the bits of the candidates skipped there.
        self.known: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.once: set[str | int] = set()
        self.words: list[str] = []
        #: Ids of a node, candidates met there (places), and candidates skipped on the way to it.
        self.start, self.size, self.ids = z, z, np.zeros(0, np.int32)
        self.met_start, self.met_size, self.met = z, z, np.zeros(0, U64)
        self.skip_start, self.skip_size, self.skip = z, z, np.zeros(0, U64)
        self.parent = z

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols merge into, -1 if there is none."""
        key = (a << 20) | b
        key[(a < 0) | (b < 0)] = -1
        at = self.held[self._bin(key)]
        out = np.where(self.keys[at] == key, self.made[at], -1)
        odd = np.flatnonzero((out < 0) & self.crowded[self._bin(key)])
        if len(odd):
            at = np.minimum(np.searchsorted(self.keys, key[odd]), len(self.keys) - 1)
            out[odd] = np.where(self.keys[at] == key[odd], self.made[at], -1)
        return out

    @staticmethod
    def _bin(key: np.ndarray) -> np.ndarray:
        return (key.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(44)

    @staticmethod
    def _place(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (start.astype(U64) << U64(42)) | (middle.astype(U64) << U64(21)) | end.astype(U64)

    @staticmethod
    def _dropped(own: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
        return mix(own ^ mix(place + U64(1))) < U64(min(int(dropout * 2**64), 2**64 - 1))

    def _many(self, symbols: np.ndarray, first: np.ndarray, dropped: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final symbols of many segments, their segments and their first characters; dropped(segments, places) tells what is skipped."""
        seg = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at = np.arange(len(symbols)) - first[seg]
        end = at + 1
        sym = symbols.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def value(i: np.ndarray) -> np.ndarray:
            """Rank and place of the merge of symbol i with the next one, NONE if there is none."""
            ok = i + 1 < len(sym)
            j = np.where(ok, i + 1, i)
            made = np.where(ok & (seg[i] == seg[j]), self._made(sym[i], sym[j]), -1)
            out = np.where(made >= 0, (self.rank[made] << 8) | at[i], NONE)
            if dropped:
                live = np.flatnonzero(made >= 0)
                k = i[live]
                out[live[dropped(seg[k], self._place(at[k], end[k], end[k + 1]))]] = NONE
            return out

        best = value(np.arange(len(sym)))
        while len(sym):
            cut = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.minimum.reduceat(best, cut)
            live = least < NONE
            if not live.all():
                rest = np.repeat(live, np.diff(np.append(cut, len(sym))))
                done.append((sym[~rest], seg[~rest], at[~rest]))
                sym, seg, at, end, best = sym[rest], seg[rest], at[rest], end[rest], best[rest]
                least = least[live]
                if not len(sym):
                    break
                cut = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            hit = np.flatnonzero(best == np.repeat(least, np.diff(np.append(cut, len(sym)))))  # one a segment
            sym[hit] = self._made(sym[hit], sym[hit + 1])
            end[hit] = end[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            sym, seg, at, end, best = sym[keep], seg[keep], at[keep], end[keep], best[keep]
            before = np.maximum(hit - 1, 0)
            best[before] = value(before)
            best[hit] = value(hit)
        if not done:
            z = np.zeros(0, np.int64)
            return z, z, z
        sym, seg, at = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((at, seg))
        return sym[order], seg[order], at[order]

    def _one(self, symbols: list[int], own: int, dropout: float) -> list[tuple[int, int]]:
        """(symbol, first character) of one long segment, by a heap."""
        n = len(symbols)
        sym, end, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []
        key = np.array([own], U64)

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (made := self.merge.get((sym[i], sym[j]))) is not None:
                if not dropout or not self._dropped(key, self._place(np.array([i]), np.array([end[i]]), np.array([end[j]])), dropout)[0]:
                    heapq.heappush(heap, (int(self.rank[made]), i, j, end[j], made))

        for i in range(n):
            push(i)
        dead = [False] * n
        while heap:
            _, i, j, e, made = heapq.heappop(heap)
            if dead[i] or dead[j] or nxt[i] != j or end[j] != e or self.merge.get((sym[i], sym[j])) != made:
                continue
            sym[i], end[i], nxt[i], dead[j] = made, end[j], nxt[j], True
            if nxt[i] < n:
                prev[nxt[i]] = i
            if prev[i] >= 0:
                push(prev[i])
            push(i)
        return [(sym[i], i) for i in range(n) if not dead[i]]

    @staticmethod
    def _own(doc: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
        """The key of the draws of a document's segments."""
        salt = mix(np.array([seed], np.int64).view(U64) + U64(1))
        return mix(mix(doc.astype(np.int64).view(U64) + salt) + mix(place.astype(U64) + salt))

    def _points(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of words, how many each has, and where each begins (one more at the end)."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        return points, size, np.concatenate([[0], np.cumsum(size)])

    def _bytes(self, points: np.ndarray, first: np.ndarray, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their segments: a symbol without a piece becomes its UTF-8 bytes."""
        odd = np.flatnonzero(sym < 0)
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[first[seg[odd]] + at[odd]].tolist()]
            width = np.ones(len(sym), np.int64)
            width[odd] = [len(r) for r in raw]
            place = np.cumsum(width) - width
            out = np.repeat(sym, width)
            to = np.repeat(place[odd], width[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
            out[to] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            sym, seg = out, np.repeat(seg, width)
        return sym, seg

    def _add(self, sym: np.ndarray, seg: np.ndarray, count: int) -> None:
        n = np.bincount(seg, minlength=count)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.size = np.concatenate([self.size, n])
        self.ids = np.concatenate([self.ids, sym.astype(np.int32)])

    def _learn(self, words: list[str], doc: int, seed: int, dropout: float) -> None:
        """Adds the ids of words that are the segments 0, 1, ... of a document, each worked off for itself."""
        n = len(words)
        sym, seg = self._direct(words, self._own(np.full(n, doc), np.arange(n), seed), dropout)
        self._add(sym, seg, n)

    def _direct(self, words: list[str], own: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with these keys, and their words."""
        points, size, first = self._points(words)
        symbols = self.char[points]
        short = np.flatnonzero(size <= LONG)
        z = np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(z, z, z)]
        if len(short):
            pick = np.repeat(size <= LONG, size)
            mine = own[short]
            sym, seg, at = self._many(symbols[pick], np.concatenate([[0], np.cumsum(size[short])]), (lambda k, place: self._dropped(mine[k], place, dropout)) if dropout else None)
            parts.append((sym, short[seg], at))
        for w in np.flatnonzero(size > LONG):
            got = self._one(symbols[first[w] : first[w + 1]].tolist(), int(own[w]), dropout)
            parts.append((np.array([s for s, _ in got], np.int64), np.full(len(got), w), np.array([i for _, i in got], np.int64)))
        sym, seg, at = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(seg, kind="stable")
        return self._bytes(points, first, sym[order], seg[order], at[order])

    def _nodes(self, words: list[str], skip: np.ndarray, skip_size: np.ndarray, seen: np.ndarray, seen_size: np.ndarray) -> int:
        """Adds a node a word, with the places skipped in it and those met before (``seen``); the first one's number."""
        points, size, first = self._points(words)
        n = len(words)
        # A place of a short word takes 21 bits, so that a word's number fits before it.
        tight = lambda seg, place: (seg.astype(U64) << U64(21)) | ((place >> U64(42)) << U64(14)) | (((place >> U64(21)) & U64(127)) << U64(7)) | (place & U64(127))
        gone = np.sort(tight(np.repeat(np.arange(n), skip_size), skip))
        met: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U64), np.zeros(0, U64))]

        def dropped(seg: np.ndarray, place: np.ndarray) -> np.ndarray:
            key = tight(seg, place)
            met.append((key, place))
            return gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] == key if len(gone) else np.zeros(len(key), bool)

        sym, seg, at = self._many(self.char[points], first, dropped)
        sym, seg = self._bytes(points, first, sym, seg, at)
        key, place = (np.concatenate(x) for x in zip(*met))
        key, one = np.unique(key, return_index=True)
        old = np.sort(tight(np.repeat(np.arange(n), seen_size), seen))
        new = old[np.minimum(np.searchsorted(old, key), len(old) - 1)] != key if len(old) else np.ones(len(key), bool)
        key, place = key[new], place[one[new]]
        number = len(self.size)
        self._add(sym, seg, n)
        m = np.bincount((key >> U64(21)).astype(np.int64), minlength=n)
        self.met_start, self.met_size, self.met = np.concatenate([self.met_start, len(self.met) + np.cumsum(m) - m]), np.concatenate([self.met_size, m]), np.concatenate([self.met, place])
        self.skip_start, self.skip_size, self.skip = np.concatenate([self.skip_start, len(self.skip) + np.cumsum(skip_size) - skip_size]), np.concatenate([self.skip_size, skip_size]), np.concatenate([self.skip, skip])
        self.words += words
        return number

    def _again(self, counts: Iterable[tuple], there: dict) -> list:
        """Of (key, count), the keys that are not there, but several times or once before."""
        once, out = self.once, []
        for k, c in counts:
            if k not in there:
                if c > 1 or k in once:
                    out.append(k)
                    once.discard(k)
                else:
                    once.add(k)
        return out

    def _children(self, keys: np.ndarray) -> None:
        """Adds the nodes of keys (node, bits of the candidates skipped there) that are asked for again."""
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
        keys = self._again(zip(keys[first].tolist(), np.diff(np.append(first, len(keys))).tolist()), self.child)
        if not keys:
            return
        keys = np.array(keys, np.int64)
        node, bits = keys >> MOST_MET, keys & ((1 << MOST_MET) - 1)
        m, before = self.met_size[node], self.skip_size[node]
        owner, within = np.repeat(np.arange(len(keys)), m), _within(m)
        place = self.met[self.met_start[node][owner] + within]
        out = ((bits[owner] >> within) & 1).astype(bool)
        old = np.repeat(np.arange(len(keys)), before)
        was = self.skip[self.skip_start[node][old] + _within(before)]
        k, p = np.concatenate([old, owner[out]]), np.concatenate([was, place[out]])
        p = p[np.argsort(k, kind="stable")]
        # Met before: skipped ones, those met at this node, and at the nodes above that led here by their drawn candidates.
        above, seen_k, seen_p = node, [k], [np.concatenate([was, place[out]])]
        rows = np.arange(len(keys))
        while len(above):
            m = self.met_size[above]
            o = np.repeat(np.arange(len(above)), m)
            seen_k.append(rows[o])
            seen_p.append(self.met[self.met_start[above][o] + _within(m)])
            up = self.parent[above]
            rows, above = rows[up >= 0], up[up >= 0]
        sk, sp = np.concatenate(seen_k), np.concatenate(seen_p)
        number = self._nodes([self.words[i] for i in node.tolist()], p, np.bincount(k, minlength=len(keys)), sp[np.argsort(sk, kind="stable")], np.bincount(sk, minlength=len(keys)))
        self.parent = np.concatenate([self.parent, node])
        self.child.update(zip(keys.tolist(), range(number, number + len(keys))))

    def _segments(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of all texts, each with a blank before it, one after another: which distinct segment stands where, those, and how many each text has.

        A segment is a line end, or a word with the blanks before it, or blanks that no word follows.
        """
        raw, off = text_buffer(texts)
        full = np.diff(off) > 0
        begin = off[:-1] + np.cumsum(full) - full
        out = np.full(len(raw) + int(full.sum()), 32, np.uint8)
        there = np.ones(len(out), bool)
        there[begin[full]] = False
        out[there] = raw
        line, blank = out == 10, out == 32
        cut = np.ones(len(out) + 1, bool)
        cut[1:-1] = line[:-1] | line[1:] | (~blank[:-1] & blank[1:])
        cut[begin] = True
        cuts = np.flatnonzero(cut)
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(out)).dictionary_encode()
        ends = np.searchsorted(cuts, np.append(begin, len(out)))
        return coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.diff(ends)

    def encode(self, texts: pa.Array | list[str | None], docs: list[int], seed: int = SEED, dropout: float = DROPOUT) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each begins (one more at the end); null and empty have none.

        ``docs`` are the doc_ids that the draws go by.
        """
        if len(self.size) + len(self.once) > self.MOST:
            self.clear()
        unit, words, counts = self._segments(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        known = self.known
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        # Words too long for a node have none.
        often = np.bincount(unit, minlength=len(words))
        new = self._again([(words[i], n) for i, n in zip(np.flatnonzero(found < 0).tolist(), often[found < 0].tolist()) if len(words[i]) <= LONG], known)
        if new:
            z, none = np.zeros(0, U64), np.zeros(len(new), np.int64)
            number = self._nodes(new, z, none, z, none)
            self.parent = np.concatenate([self.parent, none - 1])
            known.update(zip(new, range(number, number + len(new))))
            found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        node = found[unit]
        own = self._own(np.repeat(np.array(docs, np.int64), counts), _within(counts), seed)
        hard = [np.flatnonzero(node < 0)]
        todo = np.flatnonzero(node >= 0)
        while dropout and len(todo):
            wide = self.met_size[node[todo]] > MOST_MET
            hard.append(todo[wide])
            todo = todo[~wide]
            m = self.met_size[node[todo]]
            o, within = np.repeat(np.arange(len(todo)), m), _within(m)
            hit = np.flatnonzero(self._dropped(own[todo[o]], self.met[self.met_start[node[todo]][o] + within], dropout))
            bits = np.bincount(o[hit], weights=(1 << within[hit]).astype(float), minlength=len(todo)).astype(np.int64)
            some = bits > 0
            todo, bits = todo[some], bits[some]
            keys = (node[todo] << MOST_MET) | bits
            self._children(keys)
            node[todo] = np.fromiter(map(self.child.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
            hard.append(todo[node[todo] < 0])
            todo = todo[node[todo] >= 0]
        start, size, ids = self.start, self.size, self.ids
        odd = np.concatenate(hard)
        if len(odd):
            sym, seg = self._direct([words[i] for i in unit[odd].tolist()], own[odd], dropout)
            n = np.bincount(seg, minlength=len(odd))
            node[odd] = len(size) + np.arange(len(odd))
            start, size, ids = np.concatenate([start, len(ids) + np.cumsum(n) - n]), np.concatenate([size, n]), np.concatenate([ids, sym.astype(np.int32)])
        width = size[node]
        upto = np.concatenate([[0], np.cumsum(width)])
        return ids[np.repeat(start[node] - upto[:-1], width) + np.arange(upto[-1])], upto[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _encoded(batch: pa.RecordBatch, model: str, seed: int, dropout: float):
    doc = batch["doc_id"].fill_null(-1).to_pylist()
    p = pieces(model)
    for i in range(0, batch.num_rows, 1024):
        texts = batch["text"].slice(i, 1024)
        ids, cuts = p.encode(texts, doc[i : i + 1024], seed, dropout)
        yield i, texts, ids, cuts


def encode(docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, ids (array of int) and n_ids of every row of ``docs`` (doc_id, text).

    Null and empty texts have no ids.  A null doc_id counts as -1 in the draws.
    Repeated rows stay, and have the same ids.  No shuffle.
    """
    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, size = [], []
        for _, _, x, cuts in _encoded(b, model, seed, dropout):
            ids.append(x)
            size.append(np.diff(cuts))
        n = np.concatenate(size)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        return pa.RecordBatch.from_arrays([b["doc_id"], lists, pa.array(n, pa.int64())], ["doc_id", "ids", "n_ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, "doc_id long, ids array<int>, n_ids long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids); no ids give an empty text."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        p = pieces(model)
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array([p.decode(x or []) for x in b["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), f, "doc_id long, text string")


def digests(docs: DataFrame, model: str, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids) and what decoding those ids gives: decoded_chars and lossless.

    lossless tells whether the decoded text is the text (null: empty), code point by code point.
    """
    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        n, crc, chars, same = [], [], [], []
        p = pieces(model)
        for _, texts, ids, cuts in _encoded(b, model, seed, dropout):
            ids = ids.astype("<u4")
            for t, x, y in zip(texts.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                back = p.decode(ids[x:y].tolist())
                n.append(y - x)
                crc.append(zlib.crc32(memoryview(ids[x:y]).cast("B")) if y > x else 0)
                chars.append(len(back))
                same.append(back == (t or ""))
        return pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(chars, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "decoded_chars", "lossless"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), f, "doc_id long, n_ids long, ids_crc32 long, decoded_chars long, lossless boolean")
