"""Paragraphs of DOCX files, by a table function over their bytes; no library is needed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs_of(content: bytes) -> Iterator[tuple[int, str, str]]:
    """``para_no``, ``style`` and ``text`` of the body's paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for k, p in enumerate(root.iter(f"{W}p")):
        style = p.find(f"{W}pPr/{W}pStyle")
        parts = []
        for node in p.iter():
            if node.tag == f"{W}t":
                parts.append(node.text or "")
            elif node.tag == f"{W}tab":
                parts.append("\t")
            elif node.tag in (f"{W}br", f"{W}cr"):
                parts.append("\n")
        yield k, "" if style is None else style.get(f"{W}val", ""), "".join(parts)


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """``doc``, ``para_no``, ``style``, ``text`` of all DOCX files of a path. A file that is none has no rows."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("doc").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = list(paragraphs_of(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                yield pa.RecordBatch.from_pydict({"doc": [name] * len(rows), "para_no": pa.array([r[0] for r in rows], pa.int32()), "style": [r[1] for r in rows], "text": [r[2] for r in rows]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc"), "content")
    return files.mapInArrow(read, "doc string, para_no int, style string, text string")


def register_udtf(spark: SparkSession) -> None:
    """``docx_paragraphs(binary)`` for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="para_no int, style string, text string")
    class DocxParagraphs:
        def eval(self, content: bytes):
            if content is not None:
                yield from paragraphs_of(content)

    spark.udtf.register("docx_paragraphs", DocxParagraphs)
