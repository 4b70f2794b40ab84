import io
import zipfile

import pytest

from lectern.sinks import spreadsheet as sink
from lectern.sources import files, spreadsheet


def book(sheet, **parts):
    """A workbook of two sheets with given XML."""
    m, o = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    made = {
        "xl/workbook.xml": f'<workbook {m} xmlns:r="{o}"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/other/s2.xml"/></Relationships>',
        "xl/worksheets/s1.xml": f"<worksheet {m}><sheetData>{sheet}</sheetData></worksheet>",
        "xl/other/s2.xml": f'<worksheet {m}><sheetData><row r="4"><c r="B4"><v>9</v></c></row></sheetData></worksheet>',
        "xl/sharedStrings.xml": f"<sst {m}><si><t>shared</t></si><si><r><t>in </t></r><r><t>parts</t></r><rPh><t>no</t></rPh></si></sst>",
        "xl/styles.xml": f'<styleSheet {m}><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm/dd"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in (made | parts).items():
            z.writestr(name, xml)
    return out.getvalue()


def test_cells_of_all_kinds():
    sheet = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>
    <row r="3"><c r="A3" t="inlineStr"><is><t xml:space="preserve"> own </t></is></c><c r="B3"><v>1.50</v></c><c r="AB3" t="b"><v>1</v></c></row>
    <row r="5"/><row r="6"><c r="A6" t="e"><v>#N/A</v></c></row>
    <row><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>7</v></c><c t="str"><f>A1</f><v>sum</v></c><c><f>A2</f></c></row>"""
    got = list(spreadsheet.rows_of(book(sheet)))
    assert got == [
        ("One", 1, ["shared", None, "in parts"]), ("One", 3, [" own ", "1.50", *[None] * 25, "True"]),
        ("One", 7, ["2024-01-01 00:00:00", "2024-01-01 12:00:00", "7", "sum", None]), ("Two", 4, [None, "9"]),
    ]


@pytest.mark.parametrize("inline", [False, True])
def test_round_trip(spark, tmp_path, inline):
    rows = [["a & <b>", 1, None], [" é\n", 2.5, True], [None, None, None], ["a & <b>", -3, False]]
    (tmp_path / "t.xlsx").write_bytes(sink.workbook(["name", "n", "flag"], rows, inline))
    df = spreadsheet.table(spark, str(tmp_path / "t.xlsx"))
    assert df.columns == ["name", "n", "flag"]
    assert [tuple(r) for r in df.collect()] == [("a & <b>", "1", None), (" é\n", "2.5", "True"), ("a & <b>", "-3", "False")]


def test_names_of_columns(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(sink.workbook(["x", "x", None, "x"], [[1, 2, 3, 4]]))
    assert spreadsheet.table(spark, str(tmp_path / "t.xlsx")).first().asDict() == {"x": "1", "x.1": "2", "Unnamed: 2": "3", "x.2": "4"}
    assert spreadsheet.table(spark, str(tmp_path / "t.xlsx"), "none").columns == []


def test_external_tables(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(sink.workbook(["video_id", "likes"], [["v", 3]]))
    assert [tuple(r) for r in files.external_table(spark, str(tmp_path / "t.xlsx")).collect()] == [("v", "3")]
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="is no XLSX file"):
        files.external_table(spark, str(tmp_path / "bad.xlsx")).collect()
    with pytest.raises(ValueError, match="binary form"):
        files.external_table(spark, str(tmp_path / "old.xls"))


def test_columns_beyond_z():
    assert [sink.letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [spreadsheet._column(x + "7") for x in ("A", "Z", "AA", "ZZ", "AAA")] == [0, 25, 26, 701, 702]
