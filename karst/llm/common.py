"""What the corpus operators share: scratch tables, Arrow plumbing, word hashing.

Scratch tables cut lineage.  They are Parquet tables under the folder named by
``spark.checkpoint.dir`` (every executor reaches it, so a lost executor costs
one task, never a table).  They live until ``Scratch.drop`` or the end of the
driver process.
"""

from __future__ import annotations

import atexit
import ctypes
import io
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: ASCII white space, the separators of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = (9, 10, 11, 12, 13, 32)
#: Upper bound on the bytes that one Arrow batch of texts holds.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master it is set here where the session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        found = f"file://{tempfile.mkdtemp(prefix='karst-')}"
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the JVM may be gone at exit
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one run under the shared folder."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(_delete, spark, self.root)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd", wide: bool = False) -> DataFrame:
        """The same rows, read from a table: lineage ends there.

        While it is written, partitions of shuffles are put together up to the advised size,
        so that a small table is a few files and not one for each core.  ``wide`` leaves that
        to the session, for work that is more than its bytes tell.
        """
        path, first = self.path(name), "spark.sql.adaptive.coalescePartitions.parallelismFirst"
        before = self.spark.conf.get(first)
        try:
            if not wide:
                self.spark.conf.set(first, "false")
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(first, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._karst_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._karst_path)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to ``BATCH_BYTES``, if they may be larger.

    It stays set: Spark reads it when a plan runs, and that is after the call that made the plan.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that a worker has freed to the system, as the worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``f`` on batches of bounded size (``small_batches``), in Arrow."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out
        give_back()

    return df.mapInArrow(run, schema)


#: Rows of partial sums that reach the driver.
GATHERED = 8


def gather_sums(df: DataFrame, f: Callable[[pa.RecordBatch], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Sums of the arrays that ``f`` gives for a batch, None without rows.

    Each task sums its batches, then a few tasks sum those of many, so that the
    driver gets ``GATHERED`` rows however many tasks there are.
    """
    small_batches(df.sparkSession)

    def pack(total: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.tobytes() for a in total]], pa.list_(pa.binary())), pa.array([[str(a.dtype) for a in total]], pa.list_(pa.string()))], ["sums", "kinds"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = f(b)
                total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
        return pack(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for sums, kinds in zip(b["sums"].to_pylist(), b["kinds"].to_pylist(), strict=True):
                total = _added(total, _unpacked(sums, kinds))
        return pack(total)

    schema = "sums array<binary>, kinds array<string>"
    total = None
    for r in df.mapInArrow(first, schema).repartition(GATHERED).mapInArrow(again, schema).collect():
        total = _added(total, _unpacked(r.sums, r.kinds))
    return total


def _unpacked(sums: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(s, k) for s, k in zip(sums, kinds, strict=True)]


def _added(total: list[np.ndarray] | None, more: list[np.ndarray]) -> list[np.ndarray]:
    return more if total is None else [x + y for x, y in zip(total, more, strict=True)]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def texts_only(df: DataFrame, *columns: str) -> DataFrame:
    """doc_id as long and the named columns; other columns are left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in columns])


# --- hashing ---------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = int(_rng.integers(2**60, 2**63)) * 8 + 5
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
#: Bytes that work arrays of 8 bytes a byte are made for at a time, and powers that a worker keeps.
PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; kept up to ``PIECE``, as only a longer word needs more."""
    def make(base: int, size: int) -> np.ndarray:
        p = np.full(size, base, U64)
        p[0] = 1
        return np.multiply.accumulate(p)

    both = (_BASE % 2**64, pow(_BASE, -1, 2**64))
    if n > PIECE + 1:
        return make(both[0], n), make(both[1], n)
    if len(_POW[0]) < n:
        _POW[:] = [make(x, PIECE + 1) for x in both]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray, no_word: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (one more at the end).

    ``no_word`` tells which bytes stand between words.  Work is done in pieces, so a
    very long row takes little more than its words do.
    """
    n = len(raw)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, 4 * PIECE):
        b = min(n, a + 4 * PIECE)
        # One byte more on either side, none at the ends.
        lo, hi = max(a - 1, 0), min(b + 1, n)
        word = np.zeros(b - a + 2, bool)
        word[lo - a + 1 : hi - a + 1] = ~no_word[raw[lo:hi]]
        cut = np.zeros(b - a + 1, bool)
        cut[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        starts.append(np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1])) + a)
        ends.append(np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + a + 1)
    start, end = np.concatenate(starts), np.concatenate(ends)
    return start, end, np.searchsorted(start, offsets)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each of the ascending spans: a polynomial over prefix sums, then a finaliser with the length."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        # Spans that begin and end within a piece, one at least.
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        a, b = start[i:j] - lo, end[i:j] - lo
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((_LOWER if lower else _BYTE)[raw[lo:hi]] * up[: hi - lo], out=sums[1:])
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * U64(0x9E3779B97F4A7C15))
        i = j
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words, and each row's first word."""
    start, end, first = word_spans(raw, offsets)
    return span_hashes(raw, start, end), first


def chunks(raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes, so that work arrays stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# --- arrays in files -----------------------------------------------------------


def save_array(folder: str, name: str, array: np.ndarray) -> None:
    """A ``.npy`` file that is there whole or not at all, also if a lost task runs again."""
    path = local_path(folder)
    if path:
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{path}/{name}.npy")
    else:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at)
        with system.open_output_stream(f"{at}/{name}.npy") as f:
            np.save(f, array)


#: Bytes of arrays that a worker holds which it can't map from a file system.
HELD_BYTES = 256 << 20
#: Arrays that a worker keeps mapped: a system allows a process only so many maps.
HELD_MAPS = 4096
_held: OrderedDict[str, np.ndarray] = OrderedDict()


def load_array(folder: str, name: str) -> np.ndarray:
    """The array, mapped from its file.  Where the folder is in a store that has no file system, it is
    read into memory.  Those asked for longest ago leave when ``HELD_MAPS``, or ``HELD_BYTES`` in memory, are held."""
    key = f"{folder}/{name}"
    if key in _held:
        _held.move_to_end(key)
        return _held[key]
    path = local_path(folder)
    if path:
        out = np.load(f"{path}/{name}.npy", mmap_mode="r")
    else:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(folder)
        with system.open_input_stream(f"{at}/{name}.npy") as f:
            out = np.load(io.BytesIO(f.read()))
    for old in [k for k in _held if not k.startswith(folder + "/")]:  # of an earlier run
        del _held[old]
    _held[key] = out
    while len(_held) > HELD_MAPS or not path and len(_held) > 1 and sum(a.nbytes for a in _held.values()) > HELD_BYTES:
        _held.popitem(last=False)
    return out
