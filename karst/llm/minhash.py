"""Near-duplicate detection: universal hash minima, banding, exact confirmation, components.

1. A pass over the texts makes each document's set of word shingles, its size, a
   cryptographic digest of the whole set, and ``bands * rows`` universal hash minima folded
   into band keys.  Documents of one digest form a class; its least doc_id stands
   for it, so exact copies never meet each other again.
2. In each band bucket every class is paired with the bucket's centre (one row a
   member, never all pairs): the class that meets the most others over all its
   buckets, as the original of a group of edited copies does.  Pairs are confirmed
   on the full sets.
3. Components of the confirmed links (large-star, small-star).
4. What the stars could not decide: buckets that still hold several components.  Each
   is cut into blocks of bounded size, a component that fills blocks into its own, and
   blocks meet unless both belong to one component.  So a great group of copies meets
   the few others of its bucket once, and never itself.  Where blocks meet, signatures
   first tell which members may have a link to another component there; those alone
   bring their full sets, and are compared in the first band that a pair shares.  Only
   links that join components come out of it.

So a link is lost only if all bands miss it (with 32 bands of 5 rows, at similarity
0.85 that has probability 7e-9) or if its signatures differ by more than five standard
deviations, which rules a pair out.  Aggregates by bucket are written before they are
joined back, so that adaptive execution can split a bucket with very many members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.llm.common import U64, Scratch, arrow_map, chunks, give_back, i64, mix, small_batches, text_buffer, texts_only, word_hashes
from karst.llm.components import connected_components

_rng = np.random.Generator(np.random.PCG64(77))
_MULT = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * U64(2) + U64(1)
_PLUS = _rng.integers(0, 2**63, 1024, dtype=np.uint64)
_K = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Members and shingles that a block of a group holds on average.
BLOCK, BLOCK_SHINGLES = 128, 1 << 17


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after another, and each row's first (one more at the end).

    A row with fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    h, first = word_hashes(raw, offsets)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            w = h[a:b]
            s = w[: b - a - width + 1] * _K[0]
            for k in range(1, width):
                s = mix(s + U64(k)) + w[k : b - a - width + 1 + k] * _K[k % 4]
            sets.append(np.unique(mix(s)))
        elif b > a:
            s = np.full(1, b - a, U64) * _K[3]
            for k in range(a, b):
                s = mix(s + h[k : k + 1])
            sets.append(s)
        else:
            sets.append(np.zeros(0, U64))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(size)])


def _signatures(bands: int, rows: int, width: int):
    k = bands * rows

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = text_buffer(batch["text"])
        n = batch.num_rows
        size, h1, h2 = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
        keys, low = np.zeros((n, bands), U64), np.zeros((n, k), np.uint8)
        for i, j, r, o in chunks(raw, off, 1 << 19):
            s, at = shingle_sets(r, o, width)
            size[i:j] = np.diff(at)
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                continue
            cut = at[full]
            view = memoryview(s).cast("B")
            digest = b"".join(hashlib.blake2b(view[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(cut.tolist(), at[full + 1].tolist()))
            h1[i + full], h2[i + full] = np.frombuffer(digest, U64).reshape(-1, 2).T
            minima = np.empty((k, len(full)), U64)
            for x in range(k):
                minima[x] = np.minimum.reduceat(s * _MULT[x] + _PLUS[x], cut)
            minima >>= U64(32)
            low[i + full] = (minima & U64(255)).astype(np.uint8).T
            for b in range(bands):
                key = np.full(len(full), b + 1, U64) * _K[2]
                for x in range(b * rows, (b + 1) * rows):
                    key = mix(key ^ minima[x] * _K[0])
                keys[i + full, b] = key
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]), pa.int32()), pa.array(i64(keys[size > 0].ravel())))
        sig = pa.array([x.tobytes() for x in low], pa.binary())
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size), pa.array(i64(h1)), pa.array(i64(h2)), lists, sig], ["doc_id", "n_shingles", "h1", "h2", "keys", "sig"])

    return f


def _sets(width: int):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = text_buffer(batch["text"])
        parts = [shingle_sets(r, o, width) for _, _, r, o in chunks(raw, off)]
        size = np.concatenate([np.diff(at) for _, at in parts])
        values = np.concatenate([s for s, _ in parts])
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(i64(values)))], ["doc_id", "shingles"])

    return f


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * |intersection| >= percent * |union|."""
    a, b = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    near = F.least(F.size("a"), F.size("b")) * 100 >= F.greatest(F.size("a"), F.size("b")) * percent
    return pairs.join(a, "u").join(b, "v").where(near).where(both * 100 >= (F.size("a") + F.size("b") - both) * percent).select("u", "v")


def _by_cell(of_cell: Callable[[pa.Table], pa.Table | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``of_cell`` on the rows of each cell, of rows that come sorted by (key, i, j); cells of one component are left out."""

    def of_rows(t: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        comp = t["comp"].to_numpy()
        out = [of_cell(t.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a + 1 and (comp[a + 1 : b] != comp[a]).any()]
        out = [x for x in out if x is not None and x.num_rows]
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            t = pa.concat_tables([*held, pa.Table.from_batches([b])]).combine_chunks()
            change = np.zeros(max(t.num_rows - 1, 0), bool)
            for c in ("key", "i", "j"):
                x = t[c].to_numpy()
                change |= x[1:] != x[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            yield from of_rows(t, cuts)
            held = [t.slice(cuts[-1])]  # the last cell may go on
        for t in held:
            yield from of_rows(t, [0, t.num_rows])
        give_back()

    return run


def _matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """Values of a column whose rows all have one length."""
    parts = [c.flatten().to_numpy() if pa.types.is_list(c.type) else np.frombuffer(b"".join(c.to_pylist()), np.uint8) for c in column.chunks]
    return np.concatenate(parts).view(kind).reshape(-1, width)


class _Pairs:
    """The pairs of a cell that may be links: other components, near sizes and signatures, and no earlier band in common."""

    def __init__(self, t: pa.Table, minima: int, bands: int, floor: float, percent: int):
        self.comp, self.n, side = (t[c].to_numpy() for c in ("comp", "n", "side"))
        self.sig, self.keys = _matrix(t["sig"], np.uint8, minima), _matrix(t["keys"], np.int64, bands)[:, : t["band"][0].as_py()]
        self.left, self.right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        self.floor, self.percent = floor, percent

    def of(self, i: int) -> np.ndarray:
        n, m = self.n[self.right], self.n[i]
        may = self.right[(self.comp[self.right] != self.comp[i]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent)]
        if len(may):
            may = may[(self.sig[may] == self.sig[i]).mean(1) >= self.floor]
        if len(may):
            may = may[~(self.keys[may] == self.keys[i]).any(1)]
        return may


def _suspects(*rule):
    """The rows of a cell that are in a pair that may be a link."""

    def f(t: pa.Table) -> pa.Table:
        pairs, keep = _Pairs(t, *rule), np.zeros(t.num_rows, bool)
        for i in pairs.left:
            hit = pairs.of(i)
            keep[hit] = True
            keep[i] |= len(hit) > 0
        return t.filter(pa.array(keep))

    return f


def _links(*rule):
    """Links of a cell, confirmed on the full sets: as few as join what all its links join."""
    percent = rule[-1]

    def f(t: pa.Table) -> pa.Table:
        pairs, rep, out, top = _Pairs(t, *rule), t["rep"].to_numpy(), [], {}
        sets = t["shingles"].combine_chunks()
        if isinstance(sets, pa.ChunkedArray):
            sets = pa.concat_arrays(sets.chunks)
        values, at = sets.values.to_numpy().view(U64), sets.offsets.to_numpy()  # each set is sorted as unsigned

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        for i in pairs.left:
            mine = values[at[i] : at[i + 1]]
            for k in pairs.of(i):
                a, b = find(pairs.comp[i]), find(pairs.comp[k])
                if a == b:
                    continue
                other = values[at[k] : at[k + 1]]
                to = np.searchsorted(other, mine)
                to[to == len(other)] = 0
                both = int((other[to] == mine).sum())
                if both * 100 >= (len(mine) + len(other) - both) * percent:
                    top[a] = b
                    out.append((max(rep[i], rep[k]), min(rep[i], rep[k])))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return f


def _floor(percent: int, minima: int) -> float:
    """The share of equal minima below which a pair can't be at the threshold, by 5 standard deviations."""
    return percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / minima) ** 0.5


def _cells(open_: DataFrame, sc: Scratch) -> DataFrame:
    """The members of open buckets (key, band, rep, comp, n), copied to the pairs of blocks (i, j) in which they meet others.

    side is 0 for the left block of a pair, 1 for the right one, and 2 for a block that meets itself.
    """
    many = lambda count, size: F.greatest(F.ceil(count / BLOCK), F.ceil(size / BLOCK_SHINGLES))
    parts = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    parts = sc.keep(parts.withColumn("blocks", many(F.col("c"), F.col("s"))), "bucket-parts")
    # Components of one block at most share blocks; the others have their own, numbered after those.
    few = parts.where("blocks <= 1").groupBy("key").agg(many(F.sum("c"), F.sum("s")).alias("few"))
    until = F.sum("blocks").over(Window.partitionBy("key").orderBy("comp").rowsBetween(Window.unboundedPreceding, 0))
    great = parts.where("blocks > 1").select("key", "comp", "blocks", (until - F.col("blocks")).alias("begin"))
    total = great.groupBy("key").agg(F.sum("blocks").alias("great"))
    bucket = sc.keep(few.join(total, "key", "full").select("key", F.coalesce("few", F.lit(0)).alias("few"), F.coalesce("great", F.lit(0)).alias("great")), "bucket-blocks")
    great = sc.keep(great, "great-parts")
    rows = open_.join(bucket, "key").join(great, ["key", "comp"], "left")
    own = F.col("blocks").isNotNull()
    first = F.when(own, F.col("few") + F.col("begin")).otherwise(0)
    rows = rows.withColumn("at", first + F.pmod(F.xxhash64("rep"), F.coalesce("blocks", "few"))).withColumn("all", F.col("few") + F.col("great"))
    mine = lambda x: own & (x >= F.col("few") + F.col("begin")) & (x < F.col("few") + F.col("begin") + F.col("blocks"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda x: ~F.coalesce(mine(x), F.lit(False)))
    side = lambda x: F.when(x == F.col("at"), 2).otherwise((x < F.col("at")).cast("int"))
    cell = lambda x: F.struct(F.least(x, F.col("at")).alias("i"), F.greatest(x, F.col("at")).alias("j"), side(x).alias("side"))
    return rows.select("key", "band", "rep", "comp", "n", F.inline(F.transform(other, cell)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """One row a row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, component_id, kept.

    ``width`` words make a shingle; two documents are linked if ``100 * |A & B| >=
    percent * |A | B|``.  class_id is the least doc_id of equal sets, component_id
    the least doc_id reachable by links, kept tells whether it is doc_id itself.
    Null and empty texts, and texts of white space, have no shingles and are
    linked with nothing.  Rows of one doc_id count as one node.  A row without
    doc_id is returned with null class_id and component_id, and kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sc = scratch or Scratch(spark, "minhash")
    texts = texts_only(docs, "text")
    s = sc.keep(arrow_map(texts, _signatures(bands, rows, width), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary"), "signatures", "snappy", wide=True)
    # Written, so that the join back shuffles both sides itself and a class with very many members can be split.
    classes = sc.keep(s.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "class-ids")
    members = sc.keep(s.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("rep")).alias("rep")), "members")
    reps = members.where("doc_id = rep").select("rep").distinct()
    mine = s.where("n_shingles > 0").join(reps, s.doc_id == reps.rep, "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "keys", "sig").dropDuplicates(["rep", "keys"])
    mine = sc.keep(mine, "classes", "snappy")
    sc.drop(s)
    buckets = mine.select("rep", "n", F.posexplode("keys").alias("band", "key"))
    sizes = sc.keep(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "bucket-sizes")
    # A row a class that shares buckets: its places in them (at most ``bands``) and how many others it meets there.
    known = buckets.join(sizes, "key").groupBy("rep", "n").agg(F.collect_list(F.struct("band", "key")).alias("places"), F.sum("c").alias("fame"))
    known = sc.keep(known, "known")
    shared = known.select("rep", "fame", F.inline("places"))
    centre = sc.keep(shared.groupBy("key").agg(F.max(F.struct("fame", (-F.col("rep")).alias("rep"))).alias("top")).select("key", (-F.col("top.rep")).alias("m")), "centres")
    stars = shared.join(centre, "key").where("rep <> m").select(F.greatest("rep", "m").alias("u"), F.least("rep", "m").alias("v")).distinct()
    stars = sc.keep(stars, "stars")
    # The classes grow with the data, so there is no bound to broadcast them by: shuffled at every size; only their ids are hashed.
    ids = known.select(F.col("rep").alias("doc_id")).hint("shuffle_hash")
    sets = sc.keep(arrow_map(texts.join(ids, "doc_id", "left_semi"), _sets(width), "doc_id long, shingles array<long>"), "sets", "snappy", wide=True)
    links = sc.keep(_confirmed(stars, sets, percent), "links", wide=True)
    comps = sc.keep(connected_components(links, sc), "components")
    now = known.join(comps, known.rep == comps.node, "left").select("rep", "n", F.coalesce("component", "rep").alias("comp"), F.inline("places"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = sc.keep(now.join(sc.keep(mixed, "mixed"), "key"), "open")
    if not open_.isEmpty():
        rule = (bands * rows, bands, _floor(percent, bands * rows), percent)
        by_cell = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        cells = by_cell(_cells(open_, sc).join(mine.select("rep", "sig", "keys"), "rep"))
        few = sc.keep(cells.mapInArrow(_by_cell(_suspects(*rule)), cells.schema), "suspects", "snappy", wide=True)
        few = by_cell(few.join(sets, few["rep"] == sets["doc_id"]).drop("doc_id"))
        more = sc.keep(few.mapInArrow(_by_cell(_links(*rule)), "u long, v long"), "more-links", wide=True)
        if not more.isEmpty():
            comps = sc.keep(connected_components(links.union(more), sc), "components")
    kept = (
        members.join(comps, members.rep == comps.node, "left")
        .select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    out = sc.keep(kept, "result")
    sc.drop(classes, members, mine, sizes, known, centre, stars, sets, links, comps, open_)
    return out


def deduplicate(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` without the rows that are near-duplicates of one that stays; all its columns, one row of each group.

    Each row is decided for itself: of repeated rows one stays, and of several texts
    for one doc_id, or without any, each goes or stays by its own words.  The row of
    the least doc_id stays, nulls last.  Rows without words all stay.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("__karst_row"))
    # One number: whether each row has a doc_id of its own.
    own = ids.groupBy("__karst_row").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or __karst_row is null").isEmpty()
    if own:
        rows = docs.withColumn("__karst_row", F.col("doc_id").cast("long"))
    else:
        # Numbers in a written copy; they ascend with doc_id, so that the least row is the one of the least doc_id.
        sc = scratch or Scratch(docs.sparkSession, "rows")
        order = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text")
        rows = sc.keep(order.withColumn("__karst_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("__karst_row").alias("doc_id"), "text"), scratch=scratch, **options)
    # Shuffled at every size: the ids grow with the data, so there is no bound to broadcast them by; only they are hashed.
    gone = found.where("not kept").select(F.col("doc_id").alias("__karst_row")).hint("shuffle_hash")
    return rows.join(gone, "__karst_row", "left_anti").select(*[rows[c] for c in docs.columns])
