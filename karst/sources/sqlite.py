"""SQLite files as a Spark data source, and as a sink that swaps tables in one transaction.

    scan(spark, path, table)  # or, after register(spark):
    spark.read.format("karst_sqlite").option("path", p).option("table", t).load()

The file is opened read-only by every task, so it must lie where executors reach
it.  Tasks read ranges of rowid; equality tests are pushed into the query;
``_rowid`` is the row's ordinal.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

KINDS = {"INTEGER": LongType(), "REAL": DoubleType()}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("numPartitions", 4))
        self.schema, self.tests = schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (str, int, float)):
                self.tests.append((f.attribute[0], f.value))
            yield f  # Spark tests again: a column's declared kind does not bind its values

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part: Range) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        columns = ", ".join("rowid" if n == "_rowid" else quoted(n) for n in names)
        tests = "".join(f" AND {'rowid' if n == '_rowid' else quoted(n)} = ?" for n, _ in self.tests)
        made = [int if isinstance(f.dataType, LongType) else float if isinstance(f.dataType, DoubleType) else str for f in self.schema.fields]
        with connect(self.path) as c:
            for row in c.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?{tests} ORDER BY rowid", [part.low, part.high, *[v for _, v in self.tests]]):
                yield tuple(None if v is None else f(v) for f, v in zip(made, row))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "karst_sqlite"

    def schema(self) -> StructType:
        with connect(self.options["path"]) as c:
            found = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([*[StructField(x[1], KINDS.get(x[2].upper(), StringType())) for x in found], StructField("_rowid", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the source known to the session and turns on its pushed tests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def scan(spark: SparkSession, path: str, table: str, tasks: int = 4, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of a table; ``allowed`` names the tables that may be read."""
    if allowed is not None and table not in allowed:
        raise ValueError(f"{table} is not to be read")
    register(spark)
    return spark.read.format("karst_sqlite").option("path", path).option("table", table).option("numPartitions", tasks).load()


def tables(path: str) -> list[str]:
    with connect(path) as c:
        return [x[0] for x in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def write(df: DataFrame, path: str, table: str, key: str | None = None) -> int:
    """``df`` as a table of a SQLite file; the rows written.  What was there stays unless all goes well.

    Rows come to the driver a partition at a time (a SQLite file has one writer).
    They go to a staging table of a copy of the file; its count is checked, the
    table swapped in one transaction, and the copy takes the file's place.
    ``key`` must be unique.
    """
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}
    columns = ", ".join(f"{quoted(n)} {kinds.get(k, 'TEXT')}{' PRIMARY KEY' if n == key else ''}" for n, k in df.dtypes)
    copy, stage = f"{path}.{uuid.uuid4().hex[:8]}", f"_stage_{uuid.uuid4().hex[:8]}"
    if os.path.exists(path):
        shutil.copyfile(path, copy)
    try:
        c = sqlite3.connect(copy, isolation_level=None)
        c.execute("BEGIN IMMEDIATE")
        c.execute(f"CREATE TABLE {quoted(stage)} ({columns})")
        n, put = 0, f"INSERT INTO {quoted(stage)} VALUES ({', '.join('?' * len(df.columns))})"
        for row in df.toLocalIterator():
            c.execute(put, [v if v is None or isinstance(v, (int, float, str)) else str(v) for v in row])
            n += 1
        if c.execute(f"SELECT count(*) FROM {quoted(stage)}").fetchone()[0] != n:
            raise ValueError("rows are missing")
        c.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
        c.execute(f"ALTER TABLE {quoted(stage)} RENAME TO {quoted(table)}")
        c.execute("COMMIT")
        if c.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
            raise ValueError("the file is damaged")
        c.close()
        os.replace(copy, path)
        return n
    finally:
        if os.path.exists(copy):
            os.remove(copy)
