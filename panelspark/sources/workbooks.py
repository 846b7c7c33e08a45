"""Sheets of workbooks (.xlsx: XML in a zip archive), streamed by the tasks that read them.

A workbook's table is the first sheet's that has, within its first 80 rows, a cell DATE or MONTH (in any case): that row
is the header; over 20 rows and at least two columns with values have to follow. Cells come as text:
numbers as they stand, numbers in a date format as ISO dates.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.archives import paths
from panelspark.sources.storage import opened
from panelspark.sources.texts import DATE_LABELS, SourceError

HEADER_ROWS, LEAST_ROWS, LEAST_COLUMNS, ROWS = 80, 20, 2, 1 << 14
#: The numbers of the built-in date formats.
DATE_FORMATS = (*range(14, 23), *range(45, 48))
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "source string, sheet string, row_no long, at int, name string, text string"


def column_number(reference: str) -> int:
    """The column of a cell's reference (B7: 1)."""
    number = 0
    for c in reference:
        if c.isdigit():
            break
        number = number * 26 + ord(c) - 64
    return number - 1


class Workbook:
    """A workbook in an open zip archive: the names of its sheets, and their rows one after another."""

    def __init__(self, archive: zipfile.ZipFile) -> None:
        self.archive = archive
        targets = {}
        for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target")
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): targets[s.get(_RELATION)] for s in book.iter(f"{_MAIN}sheet")}
        start = 1904 if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr")) else 1900
        self.day_zero = datetime.datetime(1904, 1, 1) if start == 1904 else datetime.datetime(1899, 12, 30)
        self.strings, self.dates = list(self._strings()), self._date_styles()

    def _elements(self, name: str, tag: str) -> Iterator[ElementTree.Element]:
        """Elements one by one, each forgotten after its turn."""
        if name not in self.archive.namelist():
            return
        with self.archive.open(name) as file:
            parents = []
            for event, element in ElementTree.iterparse(file, events=("start", "end")):
                if event == "start":
                    parents.append(element)
                    continue
                parents.pop()
                if element.tag == _MAIN + tag:
                    yield element
                    parents[-1].remove(element)

    @staticmethod
    def _text(element: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))

    def _strings(self) -> Iterator[str]:
        return (self._text(e) for e in self._elements("xl/sharedStrings.xml", "si"))

    def _date_styles(self) -> set[int]:
        """The numbers of the cell styles that show dates."""
        if "xl/styles.xml" not in self.archive.namelist():
            return set()
        styles = ElementTree.fromstring(self.archive.read("xl/styles.xml"))
        formats = set(DATE_FORMATS)
        for f in styles.iter(f"{_MAIN}numFmt"):
            shown = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
            if re.search("[dmyDMY]", shown) and "General" not in shown:
                formats.add(int(f.get("numFmtId")))
        own = styles.find(f"{_MAIN}cellXfs")
        return {i for i, x in enumerate(own) if int(x.get("numFmtId", 0)) in formats} if own is not None else set()

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            return self._text(cell)
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value)]
        if kind == "n" and int(cell.get("s", 0)) in self.dates:
            moment = self.day_zero + datetime.timedelta(days=float(value))
            return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(sep=" ")
        return value

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
        """The number, from 0, and the cells by column of each row that has any."""
        before = -1
        for row in self._elements(self.sheets[sheet], "row"):
            number = int(row.get("r")) - 1 if row.get("r") else before + 1
            before, cells, at = number, {}, -1
            for cell in row.iter(f"{_MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else at + 1
                value = self._value(cell)
                if value is not None and value != "":
                    cells[at] = value
            if cells:
                yield number, cells

    def table(self) -> tuple[str, int, dict[int, str]]:
        """The sheet, the header's row and the names of the columns that have values of the first sheet that fits."""
        for sheet in self.sheets:
            header, names, used, last = None, {}, set(), 0
            for number, cells in self.rows(sheet):
                if header is None:
                    if number >= HEADER_ROWS:
                        break
                    if any(v.strip().upper() in DATE_LABELS for v in cells.values()):
                        header, names = number, cells
                    continue
                used |= cells.keys()
                last = number
            if header is not None and last - header > LEAST_ROWS and len(used) >= LEAST_COLUMNS:
                return sheet, header, {at: names.get(at, f"Unnamed: {at}") for at in sorted(used)}
        raise SourceError("no usable sheet in the workbook")


def unique_names(names: dict[int, str]) -> dict[int, str]:
    """Repeated names with a number after the first."""
    seen, out = {}, {}
    for at, name in names.items():
        n = seen[name] = seen.get(name, -1) + 1
        out[at] = f"{name}.{n}" if n else name
    return out


def cells(spark: SparkSession, path: str) -> DataFrame:
    """source, sheet, row_no, at, name and text of the cells of each workbook's table, two passes over the sheet by one task a workbook."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CELLS.split(", ")]
        for batch in batches:
            for source in batch["path"]:
                system, own = opened(source)
                with system.open_input_file(own) as file, zipfile.ZipFile(file) as archive:
                    book, out = Workbook(archive), []
                    sheet, header, names = book.table()
                    names = unique_names(names)
                    for number, row in book.rows(sheet):
                        if number > header:
                            out += [(source, sheet, number, at, names[at], text) for at, text in row.items()]
                        if len(out) >= ROWS:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=columns)

    return paths(spark, path).mapInPandas(read, CELLS)


def wide(found: DataFrame) -> DataFrame:
    """One workbook's cells as a table of text, its columns in their order: their names are read first."""
    names = [r["name"] for r in found.groupBy("at", "name").count().orderBy("at").collect()]
    rows = found.groupBy("row_no").agg(*(F.max(F.when(F.col("name") == n, F.col("text"))).alias(n) for n in names))
    return rows.drop("row_no")


def written_book(sheets: dict[str, list[list[str | float | None]]]) -> bytes:
    """A plain workbook of rows of text and numbers, texts shared."""
    shared: dict[str, int] = {}

    def cell(row: int, at: int, value: str | float) -> str:
        letters, n = "", at + 1
        while n:
            n, rest = divmod(n - 1, 26)
            letters = chr(65 + rest) + letters
        if isinstance(value, str):
            return f'<c r="{letters}{row}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
        return f'<c r="{letters}{row}"><v>{value!r}</v></c>'

    space, office = _MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        names = "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="r{i}"/>' for i, s in enumerate(sheets, 1))
        archive.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            data = "".join(f'<row r="{n}">{"".join(cell(n, at, v) for at, v in enumerate(row) if v is not None)}</row>' for n, row in enumerate(rows, 1) if row)
            archive.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{space}"><sheetData>{data}</sheetData></worksheet>')
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{space}">{"".join(f"<si><t>{escape(s)}</t></si>" for s in shared)}</sst>')
    return held.getvalue()
