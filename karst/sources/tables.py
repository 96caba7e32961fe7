"""Tables in and out.

Reads check required columns (strict: the exact list) before any plan runs.  A
write goes to a staging folder, is read back and compared, and only then takes
the target's place by rename.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder of this run that driver and executors reach: under ``spark.checkpoint.dir``, or on a local master a temporary one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        top = f"file://{tempfile.mkdtemp(prefix='karst-')}"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def require(df: DataFrame, columns: list[str], strict: bool = False) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing or strict and df.columns != columns:
        raise ValueError(f"columns missing: {missing}" if missing else f"columns must be {columns}, not {df.columns}")
    return df


def read_table(spark: SparkSession, path: str, required: list[str] | None = None, strict: bool = False, schema=None, ordinal: str | None = None) -> DataFrame:
    """A Parquet table.  ``ordinal`` adds the place of each row in its file as an ingest-time order."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    df = require(df, required or [], strict)
    return df.withColumn(ordinal, F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))) if ordinal else df


def read_records(spark: SparkSession, path: str, schema, form: str = "json") -> DataFrame:
    """JSON, CSV or ORC records by an explicit schema; nothing is inferred."""
    reader = spark.read.schema(schema)
    if form == "json":
        return reader.json(path, multiLine=True)
    if form == "csv":
        return reader.csv(path, header=True)
    return reader.format(form).load(path)


def read_database(spark: SparkSession, url: str, table: str, folder: str | None = None, **options: str) -> DataFrame:
    """A table over JDBC; the folder test is pushed to the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df if folder is None else df.where(F.col("Folder") == folder)


def list_files(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """path, size, modified and sha256 of all files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def read_aliases(df: DataFrame, entity: str = "entity", aliases: str = "aliases") -> DataFrame:
    """(alias, entity) rows of a column of alias arrays; an alias of two entities is an error when the rows are used."""
    rows = df.select(F.explode(aliases).alias("alias"), entity).distinct()
    n = rows.groupBy("alias").agg(F.count("*").alias("n"), F.first(entity).alias(entity))
    ok = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("alias of several entities: "), F.col("alias")))).otherwise(F.col(entity))
    return n.select("alias", ok.alias(entity))


def key_value_sheet(df: DataFrame, sheet: str, label: str, value: str, labels: list[str]) -> DataFrame:
    """Rows of (sheet, label, value) as one row a sheet; labels are given, so there is one shuffle and no scan for them."""
    return df.groupBy(sheet).pivot(label, labels).agg(F.first(value, ignorenulls=True))


def union_evolving(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def same_rows(a: DataFrame, b: DataFrame, fully: bool = False) -> bool:
    """Whether both hold the same rows, repeated ones counted: one aggregate a side, no rows moved.

    ``fully`` compares value by value and not by hashes: each side is sorted out against the other by a shuffle.
    """
    def values(df: DataFrame) -> list:  # maps can't be compared
        return [F.to_json(F.col(f"`{c}`")).alias(c) if df.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in df.columns]

    if fully:
        if a.columns != b.columns or [f.dataType for f in a.schema] != [f.dataType for f in b.schema]:
            return False
        a, b = a.select(*values(a)), b.select(*values(b))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def mark(df: DataFrame):
        h = F.xxhash64(*values(df))
        return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(h)).alias("x")).first()

    return a.columns == b.columns and [f.dataType for f in a.schema] == [f.dataType for f in b.schema] and mark(a) == mark(b)


def write_verified(df: DataFrame, path: str, partition_by: list[str] | None = None, fully: bool = True) -> None:
    """Staging write, comparison value by value (by hash sums if not ``fully``), swap; what was there comes back if the swap fails."""
    spark = df.sparkSession
    stage, old = f"{path}.{uuid.uuid4().hex[:8]}.stage", f"{path}.{uuid.uuid4().hex[:8]}.old"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(stage)
        if not same_rows(spark.read.parquet(stage).select(*df.columns), df, fully):
            raise ValueError("what was written is not what was to be written")
        had = fs.exists(fs_path(path))
        if had and not fs.rename(fs_path(path), fs_path(old)):
            raise OSError(f"{path} can't be moved away")
        if not fs.rename(fs_path(stage), fs_path(path)):
            if had:
                fs.rename(fs_path(old), fs_path(path))
            raise OSError(f"{path} can't be put in place")
        if had:
            fs.delete(fs_path(old), True)
    finally:
        fs.delete(fs_path(stage), True)


class Publication:
    """Several tables that change together, or not at all.

    New tables are written beside the old ones (``stage``).  ``publish`` then writes a
    journal of the renames and carries them out: the old table away, the new one in.
    Whatever stops it, ``recover`` ends in one of two states: with a journal marked as
    decided all renames are carried on to their end, without that mark all are undone.
    Every step looks at what is there, so any of them may be done again.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "publication"):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.tables: list[str] = []

    def _at(self, table: str, part: str = "") -> object:
        return self._path(f"{self.root}/{table}" if not part else f"{self.root}/.{self.name}-{part}/{table}")

    def _mark(self, part: str) -> object:
        return self._path(f"{self.root}/.{self.name}-{part}")

    def stage(self, table: str, df: DataFrame) -> None:
        """Writes a table's new rows and compares them, value by value, with what was to be written."""
        place = f"{self.root}/.{self.name}-new/{table}"
        df.write.mode("overwrite").parquet(place)
        if not same_rows(self.spark.read.parquet(place).select(*df.columns), df, fully=True):
            raise ValueError(f"what was written of {table} is not what was to be written")
        self.tables.append(table)

    def steps(self):
        """The renames, one at a time, each done when the next is asked for."""
        self._move(self._write("journal.part", "\n".join(self.tables)), self._mark("journal"))
        yield "journal"
        for t in self.tables:
            self._move(self._at(t), self._at(t, "old"))
            yield f"{t} away"
        self._move(self._write("decided.part", "yes"), self._mark("decided"))
        yield "decided"
        yield from self._finish()

    def _finish(self):
        for t in self.tables:
            self._move(self._at(t, "new"), self._at(t))
            yield f"{t} in"
        # The mark goes last: without a journal it is of no account.
        for part in ("old", "new", "journal", "decided"):
            self.fs.delete(self._mark(part), True)
            yield f"no {part}"

    def publish(self) -> None:
        try:
            for _ in self.steps():
                pass
        except Exception:
            self.recover()
            raise

    def recover(self) -> bool:
        """Ends what was begun: True if that put new tables in place, False if it undid a beginning or there was nothing to do."""
        journal = self._mark("journal")
        if not self.fs.exists(journal):
            done = self.fs.exists(self._mark("decided"))
            for part in ("old", "new", "decided", "journal.part", "decided.part"):
                self.fs.delete(self._mark(part), True)
            return done
        stream = self.fs.open(journal)
        try:
            self.tables = [t for t in bytes(stream.readAllBytes()).decode().split("\n") if t]
        finally:
            stream.close()
        if self.fs.exists(self._mark("decided")):
            for _ in self._finish():
                pass
            return True
        for t in self.tables:
            self._move(self._at(t, "old"), self._at(t))
        for part in ("old", "new", "journal", "journal.part", "decided.part"):
            self.fs.delete(self._mark(part), True)
        return False

    def _write(self, part: str, text: str) -> object:
        out = self.fs.create(self._mark(part), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return self._mark(part)

    def _move(self, source, target) -> None:
        """A rename that may have been done: nothing if the source isn't there."""
        if not self.fs.exists(source):
            return
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(source, target):
            raise OSError(f"{source.toString()} can't be renamed to {target.toString()}")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, *keys: str) -> None:
    """Rows of ``new`` into the table at ``path`` by its keys (a number or a folder, say); one key twice in ``new`` is an error.

    New columns are added to the table.  The outcome is compared before it takes the
    table's place, and each new row must be in it.
    """
    from karst.operators.reshape import upsert_any

    for key in keys:
        filled = F.trim(F.col(f"`{key}`").cast("string")) != ""
        if not new.where(filled).groupBy(F.col(f"`{key}`")).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} is not unique")
    write_verified(upsert_any(spark.read.parquet(path), new, list(keys)), path)


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Rows as JSON texts, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))
