"""A table that takes micro-batches of a stream by key, each of them once.

A batch is one folder of rows, written beside the table and put in place by a
rename that carries the batch's number: that folder is the ledger.  A batch that is
delivered again finds its number there and changes nothing, and one that broke off
has left nothing.  Writing costs what the batch has, not what the table has; a read
takes the last row of each key, and ``compact`` writes those as the new base.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH, _AT = "__karst_batch", "__karst_at"


class Incremental:
    """Rows by ``keys`` under ``path``.

    Of the rows of one key that with the greatest ``order`` counts, if columns are named,
    and of equal ones that of the later batch; without ``order`` a later batch wins.  Two
    such rows of a key in one batch, equal in ``order``, are told apart by their values.
    Null is a key like any other.  Columns of a later batch are added; earlier rows have
    nulls there.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order or []
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        top = self._hadoop.Path(self.path)
        if not self.fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(top)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{kind}-(\d+)", n)))

    def batches(self) -> list[int]:
        """Numbers of the batches that are in place, those of the base apart."""
        base = self.base()
        return [n for n in self._numbers("batch") if base is None or n > base]

    def base(self) -> int | None:
        """The last batch that the base has in it, if there is one."""
        return max(self._numbers("base"), default=None)

    def holds(self, batch: int) -> bool:
        base = self.base()
        return base is not None and batch <= base or batch in self._numbers("batch")

    def _place(self, df: DataFrame, name: str) -> bool:
        stage, target = f"{self.path}/.{name}.{uuid.uuid4().hex[:8]}", self._hadoop.Path(f"{self.path}/{name}")
        try:
            df.write.parquet(stage)
            return not self.fs.exists(target) and self.fs.rename(self._hadoop.Path(stage), target)
        finally:
            self.fs.delete(self._hadoop.Path(stage), True)

    def apply(self, rows: DataFrame, batch: int) -> bool:
        """Puts a batch in place; False if it was there.  Fit for ``foreachBatch``."""
        return not self.holds(batch) and self._place(rows, f"batch-{batch:012d}")

    def read(self) -> DataFrame | None:
        """The last row of each key; None before the first batch."""
        base, parts = self.base(), []
        if base is not None:
            parts.append(self.spark.read.parquet(f"{self.path}/base-{base:012d}").withColumn(_BATCH, F.lit(-1).cast("long")))
        parts += [self.spark.read.parquet(f"{self.path}/batch-{n:012d}").withColumn(_BATCH, F.lit(n).cast("long")) for n in self.batches()]
        if not parts:
            return None
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        columns = [c for c in rows.columns if c != _BATCH]
        whole = F.struct(*[F.col(f"`{c}`") for c in columns])
        at = F.struct(*[F.col(f"`{c}`") for c in self.order], F.col(_BATCH), F.xxhash64(whole))
        # An arg-max with partial sums: a key of very many rows is combined before it is shuffled.
        last = rows.groupBy(*[F.col(f"`{k}`").alias(f"{_AT}{i}") for i, k in enumerate(self.keys)]).agg(F.max_by(whole, at).alias(_AT))
        return last.select(f"{_AT}.*")

    def compact(self) -> None:
        """Writes what a read gives as the base; batches that it has in it and older bases go."""
        batches, old = self.batches(), self.base()
        if not batches:
            return
        if self._place(self.read(), f"base-{batches[-1]:012d}"):
            for n in batches:
                self.fs.delete(self._hadoop.Path(f"{self.path}/batch-{n:012d}"), True)
            if old is not None:
                self.fs.delete(self._hadoop.Path(f"{self.path}/base-{old:012d}"), True)

    def follow(self, stream: DataFrame, checkpoint: str, mode: str = "update", compact_every: int = 0, **options):
        """Starts a stream whose batches go into the table, compacted after each ``compact_every`` of them."""

        def put(rows: DataFrame, batch: int) -> None:
            self.apply(rows, batch)
            if compact_every and len(self.batches()) >= compact_every:
                self.compact()

        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**options or {"availableNow": True}).foreachBatch(put).start()
