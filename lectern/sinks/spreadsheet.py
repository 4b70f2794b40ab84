"""XLSX files made where their rows are: one sheet, texts as shared strings or inline, numbers as numbers."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def workbook(header: list[str], rows: list[list], inline: bool = False) -> bytes:
    """A workbook of one sheet; None is no cell. Texts are shared strings, or with ``inline`` within their cells."""
    shared: dict[str, int] = {}
    text = lambda x: f'<t xml:space="preserve">{escape(x)}</t>'

    def cell(place: str, value) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float):
            return f'<c r="{place}"><v>{value}</v></c>'
        if inline:
            return f'<c r="{place}" t="inlineStr"><is>{text(value)}</is></c>'
        return f'<c r="{place}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'

    body = "".join(f'<row r="{n}">' + "".join(cell(f"{letters(k)}{n}", v) for k, v in enumerate(row)) + "</row>" for n, row in enumerate([header, *rows], 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{TYPES}.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{TYPES}.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{OFFICE}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}" uniqueCount="{len(shared)}">' + "".join(f"<si>{text(x)}</si>" for x in shared) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, HEAD + xml)
    return out.getvalue()


def workbooks(rows: DataFrame, by: str, order: str, columns: list[str], inline: bool = False) -> DataFrame:
    """``name`` and ``content``: a workbook for each value of ``by``, with its rows in order. A sheet's million rows bound a group."""

    def make(table):
        import pyarrow as pa

        table = table.sort_by(order)
        body = [list(r) for r in zip(*(table.column(c).to_pylist() for c in columns))]
        return pa.table({"name": [f"{table.column(by)[0].as_py()}.xlsx"], "content": pa.array([workbook(columns, body, inline)], pa.binary())})

    kept = list(dict.fromkeys([by, order, *columns]))
    return rows.select(*kept).where(F.col(by).isNotNull()).groupBy(by).applyInArrow(make, "name string, content binary")
