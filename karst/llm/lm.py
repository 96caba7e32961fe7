"""Interpolated modified Kneser-Ney language model (bigrams), counted in Spark.

Counting.  Tasks turn texts into word hashes, count them in runs of ``RUN`` words
and send sorted, delta-coded packets to shards by hash; a shard merges its packets
into sorted arrays.  A word's id is its place in the sorted hashes of all shards.
Bigrams are then counted in the same way, as ``id << 32 | id``, dealt by a hash of
both words, so the followers of one very frequent word spread over all shards.
The number of shards follows the amount of text: no task holds more than a bounded
part of the corpus, and packets of a run carry one entry a distinct word or pair.
Beyond ``MOST_SHARDS`` packets go to lanes of shards first, about as many as a lane
has shards, and from there to the shards, so that a packet never holds next to nothing.

Storage.  A model is a folder of ``.npy`` files under the shared folder: sorted
hashes and counts of words by shard, sorted keys and counts of bigrams by shard,
and by id the continuation count, the context total and the numbers of followers
seen once, twice and more often.  Workers map the files into memory and search
them; from a store without a file system they read them, and hold a bounded part.

Probability.  With counts c, discounts D1, D2, D3+ from the counts of counts,

    P(w | v) = max(c(vw) - D, 0) / c(v) + (D1 N1 + D2 N2 + D3 N3) / c(v) * P(w)
    P(w)     = max(n(w) - D', 0) / n + (the discounted rest) / (V + 1)

where n(w) is the number of words before w; the last share goes to V words and the
unknown.  A text's words are followed by one end token; its first token has the
begin context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.llm.common import U64, Scratch, arrow_map, chunks, load_array, mix, save_array, small_batches, text_buffer, texts_only, word_hashes

RUN = 2_000_000
#: Code points of text for each shard of words and of bigrams.
WORD_TEXT, PAIR_TEXT = 64_000_000, 32_000_000
LEAST_SHARDS, MOST_SHARDS = 12, 1024
END = U64(0xE2D0000000000001)


# --- packets and files ---------------------------------------------------------


def pack(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted keys as differences by byte plane, and their counts, compressed."""
    step = np.diff(keys, prepend=U64(0))
    planes = [np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), *[np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in counts]]
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, columns: int = 1) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=n * (8 + 4 * columns)), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(U64).ravel(), dtype=U64)
    rest = [np.ascontiguousarray(raw[n * (8 + 4 * i) : n * (12 + 4 * i)].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64) for i in range(columns)]
    return [keys, *rest]


def summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sorted distinct keys with their columns summed."""
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
    if not len(keys):
        return [keys, *[np.zeros(0, np.int64) for _ in (parts[0][1:] if parts else [0])]]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *[np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) for i in range(1, len(parts[0]))]]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the upper bits: shards hold ascending ranges of hashes."""
    return ((h >> U64(32)) * U64(shards)) >> U64(32)


# --- counting --------------------------------------------------------------------


def _packets(keys: np.ndarray, counts: np.ndarray, to: np.ndarray, most: int, name: str) -> pa.RecordBatch:
    """Packets of sorted keys for each number of ``to``, all below ``most``."""
    order = np.argsort(to, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.searchsorted(to[order], np.arange(most + 1).astype(to.dtype))
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_pydict({name: pa.array(full, pa.int32()), "packet": pa.array([pack(keys[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]]) for i in full], pa.binary())})


def _counted(texts: DataFrame, shards: int, tokens, shard_of) -> DataFrame:
    """(shard, packet) of all texts; ``tokens`` turns texts into keys, ``shard_of`` keys into shards."""
    small_batches(texts.sparkSession)
    lanes = shards if shards <= MOST_SHARDS else int(np.ceil(np.sqrt(shards)))
    lane_of = lambda k: shard_of(k) * U64(lanes) // U64(shards)
    name = "shard" if lanes == shards else "lane"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _packets(keys, counts, lane_of(keys), lanes, name)

        for b in batches:
            raw, off = text_buffer(b["text"])
            for _, _, r, o in chunks(raw, off):
                k = tokens(r, o)
                held.append(k)
                n += len(k)
                if n >= RUN:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = summed(held)
            return _packets(keys, counts, shard_of(keys), shards, "shard")

        for b in batches:
            for packet in b["packet"].to_pylist():
                held.append(unpack(packet))
                n += len(held[-1][0])
                if n >= RUN:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    sent = texts.mapInArrow(run, f"{name} int, packet binary")
    return sent if lanes == shards else sent.repartition(lanes, "lane").mapInArrow(split, "shard int, packet binary")


def with_ends(h: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with the end token after each row's words, and each row's first."""
    return np.insert(h, first[1:], end), first + np.arange(len(first))


class Words:
    """The mapped word arrays."""

    def __init__(self, folder: str, starts: list[int]):
        self.folder, self.starts, self.shards = folder, np.array(starts, np.int64), len(starts)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        cut = np.searchsorted(_shard(h, self.shards), np.arange(self.shards + 1).astype(U64))
        for s in np.flatnonzero(np.diff(cut)):
            a, b = cut[s], cut[s + 1]
            keys = load_array(self.folder, f"hash-{s}")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h[a:b]), len(keys) - 1)
                ok = keys[at] == h[a:b]
                ids[a:b] = np.where(ok, at + self.starts[s], -1)
                counts[a:b] = np.where(ok, load_array(self.folder, f"count-{s}")[at], 0)
        return ids, counts


def _pairs_of(words: Words, begin: int):
    def tokens(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        h, first = word_hashes(raw, off)
        h, first = with_ends(h, first, END)
        u, inverse = np.unique(h, return_inverse=True)
        ids = words.look(u)[0][inverse]
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[first[:-1]] = begin
        return (before.astype(U64) << U64(32)) | ids.astype(U64)

    return tokens


def _id_packets(keys: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """By range of ids, what a shard's distinct bigrams say of their second and first words."""
    second, n = np.unique(keys & U64(0xFFFFFFFF), return_counts=True)
    first = keys >> U64(32)
    cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
    context = [np.add.reduceat(x.astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64) for x in (counts, counts == 1, counts == 2, counts > 2)]
    out = {"range": [], "kind": [], "packet": []}
    for kind, ids, columns in ((0, second, [n]), (1, first[cut], context)):
        at = np.append(np.searchsorted(ids, starts.astype(U64)), len(ids))
        for r in np.flatnonzero(np.diff(at)):
            a, b = at[r], at[r + 1]
            out["range"].append(r)
            out["kind"].append(kind)
            out["packet"].append(pack(ids[a:b].astype(U64), *[np.minimum(c[a:b], 2**32 - 1) for c in columns]))
    return pa.table({"range": pa.array(out["range"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "packet": pa.array(out["packet"], pa.binary())})


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney, between 0 and their order; 0.5, 1, 1.5 where the counts of counts say nothing."""
    out = [0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k * 0.5
        out.append(min(max(d, 0.0), k - 0.01))
    return out


class Model:
    """Where the files are, and the few numbers that belong to all of them."""

    def __init__(self, **kw):
        self.__dict__.update(kw)

    def score(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """For each row: tokens, known tokens, base score and model score."""
        h, first = word_hashes(raw, off)
        h, first = with_ends(h, first, END)
        u, inverse = np.unique(h, return_inverse=True)
        ids, counts = self.words.look(u)
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        known = ids >= 0
        before_u, total_u, rest_u = np.zeros(len(u)), np.zeros(len(u)), np.zeros(len(u))
        d = np.array(self.discounts)
        lower = np.full(len(u), self.lower_rest / (self.vocabulary + 1))
        at = np.flatnonzero(known)
        n = self._by_id("before", ids[at])
        lower[at] += np.maximum(n - np.array(self.lower_discounts)[np.minimum(n, 3)], 0) / max(1, self.pairs)
        total_u[at] = self._by_id("total", ids[at])
        rest_u[at] = d[1] * self._by_id("once", ids[at]) + d[2] * self._by_id("twice", ids[at]) + d[3] * self._by_id("more", ids[at])
        begin = np.array([self.vocabulary])
        total_b = float(self._by_id("total", begin)[0])
        rest_b = float(d[1] * self._by_id("once", begin)[0] + d[2] * self._by_id("twice", begin)[0] + d[3] * self._by_id("more", begin)[0])
        seq = ids[inverse]
        prev, total, rest = np.empty(len(seq), np.int64), np.empty(len(seq)), np.empty(len(seq))
        prev[1:], total[1:], rest[1:] = seq[:-1], total_u[inverse][:-1], rest_u[inverse][:-1]
        prev[first[:-1]], total[first[:-1]], rest[first[:-1]] = self.vocabulary, total_b, rest_b
        p = lower[inverse]
        some = total > 0
        c = np.zeros(len(seq), np.int64)
        ask = np.flatnonzero(some & (seq >= 0) & (prev >= 0))
        if len(ask):
            keys, back = np.unique((prev[ask].astype(U64) << U64(32)) | seq[ask].astype(U64), return_inverse=True)
            c[ask] = self._pair(keys)[back]
        safe = np.where(some, total, 1)
        p = np.where(some, np.maximum(c - d[np.minimum(c, 3)], 0) / safe + rest / safe * p, p)
        cut = first[:-1]
        return [np.diff(first), np.add.reduceat(known[inverse].astype(np.int64), cut), np.add.reduceat(base[inverse], cut), np.add.reduceat(np.log10(p), cut)]

    def _by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values by id; ids need not ascend."""
        out = np.zeros(len(ids), np.int64)
        r = np.searchsorted(self.words.starts, ids, "right") - 1
        r = np.maximum(r, 0)
        for s in np.unique(r):
            mine = r == s
            out[mine] = load_array(self.folder, f"{name}-{s}")[ids[mine] - self.words.starts[s]]
        return out

    def _pair(self, keys: np.ndarray) -> np.ndarray:
        shard = _shard(mix(keys), self.pair_shards)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.pair_shards + 1).astype(U64))
        out = np.zeros(len(keys), np.int64)
        for s in np.flatnonzero(np.diff(cut)):
            mine = order[cut[s] : cut[s + 1]]
            held = load_array(self.folder, f"pair-{s}")
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[mine]), len(held) - 1)
                out[mine] = np.where(held[at] == keys[mine], load_array(self.folder, f"times-{s}")[at], 0)
        return out


def fit(texts: DataFrame, scratch: Scratch) -> Model:
    """A model of all rows of ``texts`` (text).  Null is an empty text: an end token alone."""
    texts = texts.select("text")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    w_shards, p_shards = max(LEAST_SHARDS, -(-chars // WORD_TEXT)), max(LEAST_SHARDS, -(-chars // PAIR_TEXT))
    folder = scratch.path("model")

    def words(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        h, first = word_hashes(raw, off)
        return with_ends(h, first, END)[0]

    def merge_words(key, table):
        s = key[0].as_py()
        keys, counts = summed([unpack(b) for b in table["packet"].to_pylist()])
        save_array(folder, f"hash-{s}", keys)
        save_array(folder, f"count-{s}", counts)
        return pa.table({"shard": pa.array([s], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    counted = _counted(texts, w_shards, words, lambda k: _shard(k, w_shards))
    sizes = {r.shard: (r.n, r.total) for r in counted.groupBy("shard").applyInArrow(merge_words, "shard int, n long, total long").collect()}
    n = [sizes.get(s, (0, 0))[0] for s in range(w_shards)]
    for s in range(w_shards):  # shards without a word
        if s not in sizes:
            save_array(folder, f"hash-{s}", np.zeros(0, U64))
            save_array(folder, f"count-{s}", np.zeros(0, np.int64))
    starts = np.concatenate([[0], np.cumsum(n)]).tolist()
    vocabulary = starts.pop()
    if vocabulary >= 2**32 - 1:
        raise ValueError("a bigram has 32 bits for each word, and there are more words")
    tokens = sum(t for _, t in sizes.values())
    index = Words(folder, starts)
    first_ids = np.array(starts, np.int64)

    def merge_pairs(key, table):
        s = key[0].as_py()
        keys, counts = summed([unpack(b) for b in table["packet"].to_pylist()])
        save_array(folder, f"pair-{s}", keys)
        save_array(folder, f"times-{s}", np.minimum(counts, 2**32 - 1).astype(np.uint32))
        out = _id_packets(keys, counts, first_ids)
        return pa.concat_tables([out, pa.table({"range": pa.array([-1], pa.int32()), "kind": pa.array([2], pa.int32()), "packet": pa.array([np.array([len(keys), *_counts_of_counts(counts)], np.int64).tobytes()], pa.binary())})])

    counted = _counted(texts, p_shards, _pairs_of(index, vocabulary), lambda k: _shard(mix(k), p_shards))
    merged = scratch.keep(counted.groupBy("shard").applyInArrow(merge_pairs, "range int, kind int, packet binary"), "merged", "uncompressed", wide=True)
    facts = [np.frombuffer(r.packet, np.int64) for r in merged.where("kind = 2").collect()]
    pairs, *ns = np.sum(facts, 0).tolist() if facts else [0] * 5
    ends = [*starts[1:], vocabulary + 1]

    def by_id(key, table):
        r = key[0].as_py()
        size = ends[r] - starts[r]
        dense = {x: np.zeros(size, np.int64) for x in ("before", "total", "once", "twice", "more")}
        for kind, names in ((0, ["before"]), (1, ["total", "once", "twice", "more"])):
            for k, b in zip(table["kind"].to_pylist(), table["packet"].to_pylist()):
                if k == kind:
                    ids, *columns = unpack(b, len(names))
                    for name, c in zip(names, columns):
                        dense[name][ids.astype(np.int64) - starts[r]] += c
        for name, c in dense.items():
            save_array(folder, f"{name}-{r}", c)
        return pa.table({"range": pa.array([r], pa.int32()), "c": pa.array([_counts_of_counts(dense["before"])], pa.list_(pa.int64())), "kinds": pa.array([[int(((dense["before"] > 0) & (dense["before"] == k)).sum()) for k in (1, 2)] + [int((dense["before"] > 2).sum())]], pa.list_(pa.int64()))})

    done = {r.range: r for r in merged.where("kind < 2").groupBy("range").applyInArrow(by_id, "range int, c array<long>, kinds array<long>").collect()}
    for r in range(w_shards):
        if r not in done:
            for name in ("before", "total", "once", "twice", "more"):
                save_array(folder, f"{name}-{r}", np.zeros(ends[r] - starts[r], np.int64))
    cc = np.sum([r.c for r in done.values()], 0).tolist() if done else [0] * 4
    kinds = np.sum([r.kinds for r in done.values()], 0).tolist() if done else [0] * 3
    lower = _discounts(cc)
    rest = sum(d * k for d, k in zip(lower[1:], kinds)) / pairs if pairs else 1.0
    scratch.drop(merged)
    return Model(folder=folder, words=index, vocabulary=vocabulary, tokens=tokens, pairs=pairs, pair_shards=p_shards, discounts=_discounts(ns), lower_discounts=lower, lower_rest=rest)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row (doc_id, text).

    base_score is the add-one-half unigram score, score the model's log10
    probability; perplexity is 10 ** (-score / n_tokens).  Null is an empty text.
    No shuffle.
    """

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = text_buffer(b["text"])
        parts = [model.score(r, o) for _, _, r, o in chunks(raw, off, 4 << 20)]
        return pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(np.concatenate(x)) for x in zip(*parts)]], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return arrow_map(texts_only(docs, "text"), f, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def learn_and_score(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Scores of all rows by a model of the rows that are not held out (a null doc_id is not)."""
    sc = scratch or Scratch(docs.sparkSession, "lm")
    out = F.coalesce(held_out(), F.lit(False))
    model = fit(docs.where(~out), sc)
    return score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
