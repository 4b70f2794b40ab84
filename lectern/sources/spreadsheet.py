"""Rows of XLSX files, read on executors from the zipped XML; no library is needed.

All values are text, as a reader without types gives them: numbers as they are written, booleans ``True`` or ``False``, cells of a
date format as date and time, errors and empty cells null. A formula has the value that was saved with it.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from posixpath import join, normpath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: The numbers of the built-in date and time formats.
DATES = {*range(14, 23), *range(45, 48)}
ROWS = "file string, sheet string, row int, cells array<string>"


def _texts(node) -> str:
    """The text of a string item, without its phonetic readings."""
    return "".join(t.text or "" for child in node if child.tag in (f"{S}t", f"{S}r") for t in child.iter(f"{S}t"))


def _items(z: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """Elements of a part, one at a time."""
    if name in z.namelist():
        with z.open(name) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{S}{tag}":
                    yield node
                    node.clear()


def _is_date(form: str) -> bool:
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", form)
    return re.search("[ymdhs]", plain, re.I) is not None and "general" not in plain.lower()


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{S}numFmt")}
    formats = root.find(f"{S}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in (formats if formats is not None else [])]
    return {k for k, i in enumerate(ids) if (_is_date(own[i]) if i in own else i in DATES)}


def _column(place: str) -> int:
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        node = cell.find(f"{S}is")
        return None if node is None else _texts(node)
    raw = cell.findtext(f"{S}v")
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return str(raw == "1")
    if kind == "n" and int(cell.get("s", 0)) in dates:
        # days since the end of 1899; the day that 1900 is taken to have too much lies before all dates of use
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(float(raw) * 86400)))
    return raw


def rows_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, row number from 1 and cells, by place, of all rows that have any, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared, dates = [_texts(x) for x in _items(z, "xl/sharedStrings.xml", "si")], _date_styles(z)
        for sheet in book.iter(f"{S}sheet"):
            target = targets[sheet.get(f"{R}id")]
            part = target.lstrip("/") if target.startswith("/") else normpath(join("xl", target))
            number = 0
            for row in _items(z, part, "row"):
                number = int(row.get("r", number + 1))
                cells: list[str | None] = []
                for cell in row.iter(f"{S}c"):
                    at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(cell, shared, dates)
                if any(c is not None for c in cells):
                    yield sheet.get("name"), number, cells


def rows(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``sheet``, ``row`` and ``cells`` of all XLSX files of a path. A file that is none fails the job, by name."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                held: list[tuple] = []
                try:
                    for sheet, number, cells in rows_of(content):
                        held.append((name, sheet, number, cells))
                        if len(held) == 4096:
                            yield batched(pa, held)
                            held = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    raise ValueError(f"{name} is no XLSX file") from e
                yield batched(pa, held)

    def batched(pa, held):
        names, sheets, numbers, cells = zip(*held) if held else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sheets, pa.string()), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["file", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")
    return files.mapInArrow(read, ROWS)


def table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of a file, by default the first, as a table named by its first row; repeated names are numbered, missing ones made up."""
    found = rows(spark, path)
    if sheet is None:
        first = found.select("sheet").limit(1).collect()  # sheets come in order
        sheet = first[0][0] if first else None
    own = found.where(F.col("sheet") == F.lit(sheet))
    head = own.orderBy("row").limit(1).collect()  # one row
    if not head:
        return spark.createDataFrame([], "value string").drop("value")
    names: list[str] = []
    for k, c in enumerate(head[0].cells):
        name = c if c is not None else f"Unnamed: {k}"
        again = sum(n == name or re.fullmatch(re.escape(name) + r"\.\d+", n) is not None for n in names)
        names.append(f"{name}.{again}" if again else name)
    return own.where(F.col("row") > head[0].row).orderBy("row").select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
