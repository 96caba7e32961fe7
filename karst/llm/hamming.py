"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into segments of about log2(n) bits, n the number of
codes in a block, so a segment's value is shared by about one code.  Each segment
has a table from value to codes.  A query looks up, segment by segment, the values
at distance r of its own, r growing from 0.  After the segments up to j at radius r
every code at distance at most ``segments * r + j`` has been met (pigeonhole), so a
query stops as soon as k verified codes are that near: the k nearest are then
proven.  That is the only way codes are met; none is compared outside the tables.

The tables of a block are built once, by one task, and written as arrays under the
shared folder.  A task takes a slice of queries through a run of blocks, mapping
their arrays, and carries the distance of the k-th best so far: in the next block
a radius that can't beat it is not begun.  Slices and runs have fixed sizes, so how
often a block is read follows from the queries and not from the machines.

Equal codes share one entry, and of their ids the k least can matter, so a very
frequent vector costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.common import Scratch, arrow_map, load_array, save_array

#: Codes of a block on average, queries of a slice, and blocks of a run.
DATA_BLOCK, QUERY_SLICE, RUN = 1 << 20, 1 << 10, 16
#: Bits of a segment: the tables have ``2 ** bits`` entries.
LEAST_BITS, MOST_BITS = 4, 20


def codes(vectors: DataFrame, id_column: str, vector: str, bits: int) -> DataFrame:
    """id and code (bytes; bit i is set if component i is 0 or more).

    Rows whose id or vector is null, or whose vector has not ``bits`` components, have no code
    and are left out; a component that is null or not a number counts as below 0.
    """

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        v = b["v"].flatten()
        x = v.fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, bits)
        packed = np.packbits(x >= 0, axis=1, bitorder="little")
        return pa.RecordBatch.from_arrays([b["id"], pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "code"])

    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return arrow_map(rows.where(F.col("id").isNotNull() & (F.size("v") == bits)), f, "id long, code binary")


@cache
def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` of them set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


def cuts(bits: int, n: int) -> list[int]:
    """Where the segments of ``n`` codes begin (one more at the end); their widths differ by one at most."""
    width = min(max(int(n).bit_length() - 1, LEAST_BITS), MOST_BITS, bits)
    segments = -(-bits // width)
    return [i * bits // segments for i in range(segments + 1)]


def _values(code: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits a to b of codes (rows of 64-bit words) as numbers."""
    word, shift = divmod(a, 64)
    out = code[:, word] >> np.uint64(shift)
    if b > 64 * (word + 1):
        out = out | (code[:, word + 1] << np.uint64(64 - shift))
    return (out & np.uint64((1 << (b - a)) - 1)).astype(np.int64)


def tables(ids: np.ndarray, code: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The arrays of an index: distinct codes, the ids of each (ascending), and each segment's table."""
    order = np.lexsort((ids, *code.T))
    ids, code = ids[order], code[order]
    new = np.ones(len(ids), bool)
    new[1:] = (code[1:] != code[:-1]).any(1)
    first = np.flatnonzero(new)
    out = {"code": code[first], "first": np.append(first, len(ids)), "ids": ids}
    at = cuts(code.shape[1] * 64, len(first))
    for s, (a, b) in enumerate(zip(at, at[1:])):
        value = _values(out["code"], a, b)
        out[f"order-{s}"] = np.argsort(value, kind="stable").astype(np.int32)
        out[f"start-{s}"] = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << (b - a)))]).astype(np.int32)
    return out


class Index:
    """A searcher over such arrays; ``of`` gives one by its name."""

    def __init__(self, of, k: int):
        self.code, self.first, self.ids, self.k = of("code"), of("first"), of("ids"), k
        self.cuts = cuts(self.code.shape[1] * 64, len(self.code))
        self.segments = len(self.cuts) - 1
        self.order, self.start = [[of(f"{x}-{s}") for s in range(self.segments)] for x in ("order", "start")]
        self.copies = np.minimum(np.diff(self.first), k)
        self.seen = np.zeros(len(self.code), bool)
        #: Queries asked, radii begun, values looked up and codes verified.
        self.asked = self.radii = self.lookups = self.verified = 0

    def nearest(self, query: np.ndarray, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of the k nearest, ties by id; all codes if there are fewer than k.

        With a ``bound``, codes farther than it are of no use and may be left out.
        """
        bits, seen = self.code.shape[1] * 64, self.seen
        near = np.zeros(bits + 1, np.int64)  # copies by distance
        got: list[np.ndarray] = [np.zeros(0, np.int64)]
        far: list[np.ndarray] = [np.zeros(0, np.int64)]
        last = bits if bound is None else bound
        own = [int(_values(query[None], a, b)[0]) for a, b in zip(self.cuts, self.cuts[1:])]
        proven = met = 0
        self.asked += 1
        for radius in range(max(np.diff(self.cuts)) + 1):
            self.radii += 1
            for s in range(self.segments):
                value = own[s] ^ masks(self.cuts[s + 1] - self.cuts[s], radius)
                self.lookups += len(value)
                a, b = self.start[s][value].astype(np.int64), self.start[s][value + 1]
                n = b - a
                some = n > 0
                if some.any():
                    a, n = a[some], n[some]
                    at = self.order[s][np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    at = at[~seen[at]]
                    if len(at):
                        seen[at] = True
                        d = np.bitwise_count(self.code[at] ^ query).sum(1).astype(np.int64)
                        np.add.at(near, d, self.copies[at])
                        got.append(at)
                        far.append(d)
                        met += len(at)
                # Every code that near has been met.
                proven = self.segments * radius + s
                if near[: proven + 1].sum() >= self.k or proven >= last:
                    break
            else:
                if met < len(self.code):
                    continue
            break
        at, d = np.concatenate(got), np.concatenate(far)
        seen[at] = False
        self.verified += met
        keep = d <= min(last, int(np.searchsorted(np.cumsum(near), self.k)))
        at, d = at[keep], d[keep]
        n = self.copies[at]
        ids = self.ids[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        d = np.repeat(d, n)
        top = np.lexsort((ids, d))[: self.k]
        return ids[top], d[top]


def _built(folder: str, k: int, words: int):
    def f(key: tuple, table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).view(np.uint64).reshape(-1, words)
        made = tables(table["id"].to_numpy(), code, k)
        for name, array in made.items():
            save_array(folder, f"{b}-{name}", array)
        return pa.table({"block": pa.array([b], pa.int64()), "codes": [len(made["code"])]})

    return f


def _answered(folder: str, k: int, words: int):
    """Answers of each slice, which is a run of rows, from the blocks of its run."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b["id"].to_numpy()
            code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).view(np.uint64).reshape(-1, words)
            blocks = [tuple(x) for x in b["blocks"].to_pylist()]
            order = sorted(range(len(ids)), key=blocks.__getitem__)
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for run in sorted(set(blocks)):
                mine = [i for i in order if blocks[i] == run]
                for block in run:
                    index = Index(lambda name: load_array(folder, f"{block}-{name}"), k)
                    for i in mine:
                        old = best.get(i)
                        full = old is not None and len(old[0]) == k
                        found = index.nearest(code[i], int(old[1][-1]) if full else None)
                        if old is not None:
                            x, d = np.concatenate([old[0], found[0]]), np.concatenate([old[1], found[1]])
                            # An id that has several codes counts once, by the nearest.
                            top = np.lexsort((x, d))
                            x, d = x[top], d[top]
                            one = np.sort(np.unique(x, return_index=True)[1])[:k]
                            found = x[one], d[one]
                        best[i] = found
            n = [len(best[i][0]) for i in range(len(ids))]
            x, d = (np.concatenate([best[i][c] for i in range(len(ids))]) for c in (0, 1))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, n)), "id": pa.array(x.astype(np.int64)), "distance": pa.array(d)})

    return f


def top_k(vectors: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int = 10, bits: int = 64) -> DataFrame:
    """The k nearest rows of ``vectors`` for each row of ``queries``: query_id, rank (from 1), id, distance.

    A query finds itself if it is among the vectors.  Ties go by id.  Repeated rows of
    one id count as one; of several codes for one id the least counts.  Codes as in
    ``codes``; queries without a code have no rows, nor has any without vectors.
    """
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    spark = vectors.sparkSession
    sc = Scratch(spark, "hamming")
    # Of equal codes the k least ids; Spark limits each group before it shuffles it.
    alike = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    one = lambda df: codes(df, id_column, vector, bits).groupBy("id").agg(F.min("code").alias("code"))
    data = sc.keep(one(vectors).withColumn("n", alike).where(F.col("n") <= k).select("id", "code"), "codes")
    ask = sc.keep(one(queries), "queries")
    n, m = data.count(), ask.count()
    folder = sc.path("index")
    block = F.pmod(F.xxhash64("code"), F.lit(max(1, -(-n // DATA_BLOCK)))).alias("block")
    built = data.select("id", "code", block).groupBy("block").applyInArrow(_built(folder, k, bits // 64), "block long, codes long")
    blocks = sorted(r.block for r in built.collect())  # a number for each ``DATA_BLOCK`` codes
    runs = [blocks[i : i + RUN] for i in range(0, len(blocks), RUN)]
    every = F.explode(F.array(*[F.array(*[F.lit(b).cast("long") for b in run]) for run in runs]) if runs else F.array().cast("array<array<bigint>>")).alias("blocks")
    slices = max(1, -(-m * len(runs) // QUERY_SLICE))
    asked = ask.select("id", "code", every).repartition(slices, "id", "blocks")
    found = asked.mapInArrow(_answered(folder, k, bits // 64), "query_id long, id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
