"""Spreadsheet workbooks (xlsx) by the standard library: cells in as text, tables out."""

from __future__ import annotations

import datetime as dt
import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that are dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
ROWS = "path string, sheet string, row long, cells array<string>"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_M}t"))


def _when(number: float) -> str:
    at = dt.datetime(1899, 12, 30) + dt.timedelta(days=number)
    at = (at + dt.timedelta(microseconds=500)).replace(microsecond=0)
    return at.date().isoformat() if number == int(number) else at.isoformat(" ")


def parse(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of every row that has cells; dates are ISO texts, whole numbers have no places."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ElementTree.fromstring(z.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", x.get("formatCode", "")) for x in styles.iter(f"{_M}numFmt")}
        for x in styles.findall(f"{_M}cellXfs/{_M}xf"):
            i = int(x.get("numFmtId", 0))
            dated.append(i in DATE_FORMATS or bool(re.search("[ymdhs]", own.get(i, ""), re.I)))
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet"):
        target = links[s.get(f"{_R}id")]
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_M}row"):
            cells: list[str | None] = []
            for c in row.findall(f"{_M}c"):
                kind, v = c.get("t", "n"), c.find(f"{_M}v")
                if kind == "inlineStr":
                    value = _text(c)
                elif v is None or v.text is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                elif kind == "b":
                    value = "TRUE" if v.text == "1" else "FALSE"
                elif kind == "n":
                    x = float(v.text)
                    style = int(c.get("s", 0))
                    value = _when(x) if style < len(dated) and dated[style] else str(int(x)) if x == int(x) and abs(x) < 1e15 else v.text
                else:
                    value = v.text
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = value
            if any(x is not None for x in cells):
                yield s.get("name"), int(row.get("r", 0)), cells


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row and cells of all workbooks at ``path``; a task holds one workbook at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b["path"].to_pylist(), b["content"]):
                rows = list(parse(content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_pydict({"path": [p] * len(rows), "sheet": [r[0] for r in rows], "row": pa.array([r[1] for r in rows], pa.int64()), "cells": pa.array([r[2] for r in rows], pa.list_(pa.string()))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def as_table(rows: DataFrame, sheet: str, expected: list[str] | None = None) -> DataFrame:
    """A sheet whose first row is the header, all text, blank as null, with ``_row``.  Blank or repeated headings, or others than expected, are errors."""
    mine = rows.where(F.col("sheet") == sheet)
    # One heading a workbook; two that differ are enough to know.
    heads = mine.groupBy("path").agg(F.min("row").alias("first"), F.min_by("cells", "row").alias("head"))
    head = heads.select("head").distinct().limit(2).collect()
    if not head:
        raise ValueError(f"no sheet {sheet}")
    if len(head) > 1:
        raise ValueError(f"workbooks with different headings: {head}")
    names = [(c or "").strip() for c in head[0]["head"]]
    if "" in names or len(set(names)) < len(names):
        raise ValueError(f"blank or repeated headings: {names}")
    if expected is not None and names != expected:
        raise ValueError(f"headings must be {expected}, not {names}")
    cell = lambda i, n: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit("")).alias(n)
    out = mine.join(heads.select("path", "first"), "path").where("row > first").select(F.col("row").alias("_row"), *[cell(i, n) for i, n in enumerate(names)])
    return out.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


def as_records(rows: DataFrame, labels: list[str], first_row: int = 1) -> DataFrame:
    """A row a sheet of each workbook out of sheets of (label, value, more): values by label, ``more`` added after a bar."""
    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    pairs = rows.where(F.col("row") >= first_row).select("path", "sheet", cell(0).alias("label"), F.concat_ws(" | ", cell(1), cell(2)).alias("value"))
    return pairs.groupBy("path", "sheet").pivot("label", labels).agg(F.first(F.nullif("value", F.lit(""))))


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write(df: DataFrame, path: str, sheet: str = "Sheet1") -> int:
    """``df`` as a workbook of one sheet, put in place when it is whole; the rows written.  Rows pass through the driver one by one."""
    stage, n = f"{path}.{uuid.uuid4().hex[:8]}", 1
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = dict(df.dtypes)

    def row(i: int, values: list, head: bool = False) -> str:
        cells = []
        for k, v in enumerate(values):
            if v is None:
                continue
            if not head and kinds[df.columns[k]] in ("int", "bigint", "double") and v == v:
                cells.append(f'<c r="{_name(k)}{i}"><v>{v}</v></c>')
            else:
                text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
                cells.append(f'<c r="{_name(k)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        return f'<row r="{i}">{"".join(cells)}</row>'

    try:
        with zipfile.ZipFile(stage, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="a"/></sheets></workbook>')
            with z.open("xl/worksheets/sheet1.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                f.write(row(1, df.columns, True).encode())
                for r in df.toLocalIterator():
                    n += 1
                    f.write(row(n, list(r)).encode())
                f.write(b"</sheetData></worksheet>")
        os.replace(stage, path)
        return n - 1
    finally:
        if os.path.exists(stage):
            os.remove(stage)
