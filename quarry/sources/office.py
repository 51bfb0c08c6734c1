"""Word and Excel files as records with their place: one for each cell of a table's grid, merged cells on both axes resolved.

Files are read by Spark (binaryFile), so any store will do, and each file is parsed in one task by the standard
library's zip and XML readers.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: kind: cell, title (a paragraph outside tables), textbox or error. origin: whether the cell begins here, or covers this place by a merge.
RECORD = "path string, sha1 string, kind string, table int, title string, row int, column int, origin boolean, text string"

#: Namespaces of the two formats, and Excel's built-in number formats that are dates or times.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATES = frozenset([*range(14, 23), *range(45, 48)])

Part = tuple  # (kind, table, title, row, column, origin, text)


def _own_text(node: ElementTree.Element, skip: Sequence[str]) -> str:
    """Text of a Word element without what stands in elements to skip."""
    out: list[str] = []

    def walk(x: ElementTree.Element) -> None:
        for child in x:
            if child.tag in skip:
                continue
            if child.tag == _W + "t":
                out.append(child.text or "")
            elif child.tag == _W + "tab":
                out.append("\t")
            elif child.tag in (_W + "br", _W + "cr"):
                out.append("\n")
            walk(child)

    walk(node)
    return "".join(out)


def _paragraphs(node: ElementTree.Element) -> str:
    """The paragraphs of a cell or box, those of tables within it left out, one a line."""
    found: list[str] = []

    def walk(x: ElementTree.Element) -> None:
        for child in x:
            if child.tag == _W + "p":
                found.append(_own_text(child, (_W + "txbxContent",)))
            elif child.tag != _W + "tbl":
                walk(child)

    walk(node)
    return "\n".join(found)


def _number(node: ElementTree.Element | None, default: int) -> int:
    value = "" if node is None else node.get(_W + "val", "")
    return int(value) if value.isdigit() else default


def _word(package: zipfile.ZipFile) -> Iterator[Part]:
    root = ElementTree.fromstring(package.read("word/document.xml"))
    table, before, boxes = -1, "", []

    def grid(node: ElementTree.Element, title: str, number: int) -> Iterator[Part]:
        above: dict[int, str] = {}
        for r, row in enumerate(node.findall(_W + "tr")):
            at, current = _number(row.find(f"{_W}trPr/{_W}gridBefore"), 0), {}
            for cell in row.findall(_W + "tc"):
                span = max(1, _number(cell.find(f"{_W}tcPr/{_W}gridSpan"), 1))
                merge = cell.find(f"{_W}tcPr/{_W}vMerge")
                goes_on = merge is not None and merge.get(_W + "val", "continue") == "continue"
                text = above.get(at, "") if goes_on else _paragraphs(cell)
                for column in range(at, at + span):
                    current[column] = text
                    yield "cell", number, title, r, column, column == at and not goes_on, text
                at += span
            above = current

    places = 0
    for node in root.find(_W + "body") if root.find(_W + "body") is not None else ():
        if node.tag == _W + "p":
            text = _own_text(node, (_W + "txbxContent",))
            if text.strip():
                before = text
                yield "title", None, None, places, None, None, text
            places += 1
            for box in node.iter(_W + "txbxContent"):
                inside = _paragraphs(box)
                if inside and inside not in boxes:
                    boxes.append(inside)
                    yield "textbox", None, None, len(boxes) - 1, None, None, inside
        elif node.tag == _W + "tbl":
            for one in node.iter(_W + "tbl"):  # a table and those within its cells
                table += 1
                yield from grid(one, before, table)


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(digits) - 1, column - 1


def _date_styles(package: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in package.namelist():
        return set()
    root = ElementTree.fromstring(package.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", x.get("formatCode", "")) for x in root.iter(_S + "numFmt")}
    kinds = [int(x.get("numFmtId", "0")) for x in root.findall(f"{_S}cellXfs/{_S}xf")]
    return {k for k, kind in enumerate(kinds) if kind in _DATES or re.search(r"[ymdhs]", own.get(kind, ""), re.IGNORECASE)}


def _as_date(number: str, epoch: dt.datetime) -> str:
    moment = epoch + dt.timedelta(seconds=round(float(number) * 86400))
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(sep=" ")


def _excel(package: zipfile.ZipFile) -> Iterator[Part]:
    names = package.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in x.iter(_S + "t")) for x in ElementTree.fromstring(package.read("xl/sharedStrings.xml")).iter(_S + "si")]
    book = ElementTree.fromstring(package.read("xl/workbook.xml"))
    targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
    setting, dates = book.find(_S + "workbookPr"), _date_styles(package)
    epoch = dt.datetime(1904, 1, 1) if setting is not None and setting.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    for table, sheet in enumerate(book.iter(_S + "sheet")):
        target = targets[sheet.get(_R)]
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath("xl/" + target)
        cells, merges = {}, []
        with package.open(path) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag == _S + "c" and node.get("r"):
                    value = node.find(_S + "v")
                    text = "" if value is None else value.text or ""
                    if node.get("t") == "s" and text:
                        text = shared[int(text)]
                    elif node.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in node.iter(_S + "t"))
                    elif node.get("t") == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    elif node.get("t") in (None, "n") and text and int(node.get("s", "0")) in dates:
                        text = _as_date(text, epoch)
                    cells[_place(node.get("r"))] = (True, text)
                elif node.tag == _S + "mergeCell":
                    merges.append([_place(x) for x in node.get("ref").split(":")])
                elif node.tag == _S + "row":
                    node.clear()
        rows, columns = (max((p[k] for p in cells), default=-1) for k in (0, 1))
        for (top, left), (bottom, right) in merges:
            text = cells.get((top, left), (True, ""))[1]
            for r in range(top, min(bottom, rows) + 1):  # a merge may reach beyond what the sheet uses
                for c in range(left, min(right, columns) + 1):
                    cells[r, c] = ((r, c) == (top, left), text)
        for (r, c), (origin, text) in sorted(cells.items()):
            yield "cell", table, sheet.get("name"), r, c, origin, text


def parse(content: bytes, extension: str) -> list[Part]:
    """Records of one file; one error record where it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            return list(_excel(package) if extension == "xlsx" else _word(package))
    except (zipfile.BadZipFile, KeyError, ValueError, AttributeError, IndexError, EOFError, NotImplementedError, RuntimeError, ElementTree.ParseError) as e:
        return [("error", None, None, None, None, None, f"{type(e).__name__}: {e}")]


def records(files: DataFrame) -> DataFrame:
    """Records (RECORD) of the .docx and .xlsx files among files (path, extension, content), as sources.documents.scan() gives them.

    Spark does not list files of no bytes, so these give no record, and a file without any text gives none either.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, extension, content in zip(*batch.columns, strict=True):
                data = content.as_py() or b""
                found = [(path.as_py(), hashlib.sha1(data).hexdigest(), *part) for part in parse(data, extension.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    office = files.where(F.col("extension").isin("docx", "xlsx"))
    return office.select("path", "extension", "content").mapInArrow(run, RECORD)


TABLE = ["path", "sha1", "table"]


def grid_rows(cells: DataFrame) -> DataFrame:
    """(path, sha1, table, title, row, cells, texts): rows of tables; cells maps columns to texts, texts are those of cells that begin there."""
    rows = cells.where("kind = 'cell'").groupBy(*TABLE, "row").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("column", "text", "origin"))).alias("c"))
    own = F.transform(F.filter("c", lambda x: x["origin"]), lambda x: x["text"])
    return rows.select(*TABLE, "title", "row", F.map_from_arrays("c.column", "c.text").alias("cells"), own.alias("texts"))


def headed(rows: DataFrame, wanted: Sequence[str], aliases: dict[str, str] | None = None, within: int = 4, fold: object = F.trim) -> DataFrame:
    """(path, sha1, table, title, row, section, fields) of the rows below each table's header.

    The header is the first of a table's first rows that has all wanted headings, whatever columns they stand in; fields
    maps headings, by their aliases, to texts. A row of a single text is a heading of the rows that follow: it is no
    row itself and stands in section. Tables without such a header are left out.
    """
    folded = F.transform(F.map_values("cells"), lambda t: fold(t))
    names = F.lit(None) if not aliases else F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    known = lambda t: fold(t) if not aliases else F.coalesce(F.element_at(names, fold(t)), fold(t))
    has_all = F.size(F.array_except(F.array(*map(F.lit, wanted)), F.transform(folded, known) if aliases else folded)) == 0
    heads = rows.where((F.col("row") < within) & has_all).groupBy(*TABLE).agg(F.min_by(F.struct("row", "cells"), "row").alias("head"))
    headings = F.transform_values("head.cells", lambda _, t: known(t))
    below = rows.join(heads.select(*TABLE, F.col("head.row").alias("head_row"), headings.alias("headings")), TABLE).where("row > head_row")
    filled = F.filter("texts", lambda t: F.trim(t) != "")
    marked = below.withColumn("alone", F.when(F.size(filled) == 1, F.get(filled, F.lit(0)))).where(F.size(filled) > 0)
    order = Window.partitionBy(*TABLE).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumn("section", F.last("alone", ignorenulls=True).over(order)).where("alone IS NULL")
    columns = F.filter(F.map_keys("headings"), lambda c: F.element_at("headings", c) != "")
    pairs = F.transform(columns, lambda c: F.struct(F.element_at("headings", c).alias("k"), F.coalesce(F.element_at("cells", c), F.lit("")).alias("v")))
    fields = F.map_from_entries(_first_of_each(pairs))
    return carried.select(*TABLE, "title", "row", "section", fields.alias("fields"))


def _first_of_each(pairs: Column) -> Column:
    """Entries of which the first of each key is kept: a heading that spans columns names the first of them."""
    keys = F.transform(pairs, lambda p: p["k"])
    return F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
