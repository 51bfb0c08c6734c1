"""Word and Excel files made here, read back with their merges."""

import io
import zipfile

from pyspark.sql import functions as F

from quarry.sources import documents, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def cell(text, span=1, merge=None):
    marks = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + ({"start": '<w:vMerge w:val="restart"/>', "on": "<w:vMerge/>"}.get(merge, ""))
    lines = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in text.split("\n"))
    return f"<w:tc><w:tcPr>{marks}</w:tcPr>{lines}</w:tc>"


def word(*body):
    return packed({"word/document.xml": f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>"})


def row(*cells, before=0):
    start = f'<w:trPr><w:gridBefore w:val="{before}"/></w:trPr>' if before else ""
    return f"<w:tr>{start}{''.join(cells)}</w:tr>"


def paragraph(text):
    return f"<w:p><w:r><w:t>{text}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>"


def table(*rows):
    return f"<w:tbl>{''.join(rows)}</w:tbl>"


def excel():
    sheet = (
        f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>date</t></is></c></row>'
        '<row r="2"><c r="A2"><v>12</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" s="1"><v>43466</v></c></row>'
        '<row r="3"><c r="A3" t="str"><v>x</v></c><c r="C3" s="2"><v>43466.5</v></c></row><row r="4"><c r="AA4"><v>1</v></c></row></sheetData>'
        '<mergeCells count="2"><mergeCell ref="A1:B1"/><mergeCell ref="A3:B1048576"/></mergeCells></worksheet>'
    )
    return packed({
        "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Names" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="t" Target="worksheets/other.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><r><t>na</t></r><r><t>me</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm h:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/other.xml": sheet,
    })


def files(spark, tmp_path, contents):
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    return documents.scan(spark, str(tmp_path))


def places(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_word_cells_with_merges_on_both_axes(spark, tmp_path):
    made = word(
        paragraph("Title"),
        table(row(cell("a", span=2, merge="start"), cell("b\nc")), row(cell("", span=2, merge="on"), cell("d", merge="start")), row(cell("e"), cell("f"), cell("", merge="on")), row(cell("g"), before=2)),
        "<w:p><w:r><w:txbxContent><w:p><w:r><w:t>signed</w:t></w:r></w:p></w:txbxContent></w:r></w:p>",
        table(row(f"<w:tc><w:p><w:r><w:t>out</w:t></w:r></w:p>{table(row(cell('in')))}</w:tc>")),
    )
    found = office.records(files(spark, tmp_path, {"one.docx": made}))
    cells = places(found.where("kind = 'cell'"), "table", "row", "column", "origin", "text")
    assert cells == sorted([
        (0, 0, 0, True, "a"), (0, 0, 1, False, "a"), (0, 0, 2, True, "b\nc"), (0, 1, 0, False, "a"), (0, 1, 1, False, "a"), (0, 1, 2, True, "d"),
        (0, 2, 0, True, "e"), (0, 2, 1, True, "f"), (0, 2, 2, False, "d"), (0, 3, 2, True, "g"), (1, 0, 0, True, "out"), (2, 0, 0, True, "in"),
    ], key=str)
    assert places(found.where("kind <> 'cell'"), "kind", "row", "text") == [("textbox", 0, "signed"), ("title", 0, "Title\tend")]
    assert {r["title"] for r in found.where("kind = 'cell'").collect()} == {"Title\tend"}
    assert len({r["sha1"] for r in found.collect()}) == 1


def test_excel_cells_dates_and_merges(spark, tmp_path):
    found = office.records(files(spark, tmp_path, {"one.xlsx": excel()}))
    assert places(found, "title", "row", "column", "origin", "text") == sorted([
        ("Names", 0, 0, True, "name"), ("Names", 0, 1, False, "name"), ("Names", 0, 2, True, "date"), ("Names", 1, 0, True, "12"), ("Names", 1, 1, True, "TRUE"), ("Names", 1, 2, True, "2019-01-01"),
        ("Names", 2, 0, True, "x"), ("Names", 2, 1, False, "x"), ("Names", 2, 2, True, "2019-01-01 12:00:00"), ("Names", 3, 0, False, "x"), ("Names", 3, 1, False, "x"), ("Names", 3, 26, True, "1"),
    ], key=str)


def test_broken_files_give_error_records(spark, tmp_path):
    found = office.records(files(spark, tmp_path, {"a.docx": b"not a zip", "b.docx": packed({"word/other.xml": "<x/>"}), "c.xlsx": packed({"xl/workbook.xml": "<broken"}), "d.docx": b"", "e.txt": b"x", "f.docx": word()}))
    assert places(found.select(F.element_at(F.split("path", "/"), -1).alias("f"), "kind", F.substring_index("text", ":", 1).alias("e")), "f", "kind", "e") == [
        ("a.docx", "error", "BadZipFile"), ("b.docx", "error", "KeyError"), ("c.xlsx", "error", "ParseError"),
    ]


def test_rows_below_a_header_found_by_its_headings(spark, tmp_path):
    one = word(table(row(cell("List of all", span=3)), row(cell("Rank"), cell("Full name"), cell("Post", span=1)), row(cell("North", span=3)), row(cell("Col"), cell("Adam"), cell("gate")), row(cell("South", span=3)), row(cell("Maj"), cell("Basem"), cell("")), row(cell(""), cell(""), cell(""))))
    two = word(table(row(cell("Post"), cell("Name", span=2), cell("Rank")), row(cell("door"), cell("Carim"), cell("ignored"), cell("Gen"))), table(row(cell("Name"), cell("no header here"))))
    rows = office.grid_rows(office.records(files(spark, tmp_path, {"1.docx": one, "2.docx": two})))
    found = office.headed(rows, ["Rank", "Name"], {"Full name": "Name"})
    got = sorted(((r["section"], r["row"], r["fields"]) for r in found.collect()), key=str)
    assert got == sorted([("North", 3, {"Rank": "Col", "Name": "Adam", "Post": "gate"}), ("South", 5, {"Rank": "Maj", "Name": "Basem", "Post": ""}), (None, 1, {"Rank": "Gen", "Name": "Carim", "Post": "door"})], key=str)
