"""Files in pieces, archives and workbooks against the plain reader of texts."""

import datetime
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from panelspark.sources import archives, pieces, storage, texts, workbooks

TABLE = "\n".join(f"{d}, {d % 7}.5, -99.99, x{d}, {d / 3}" for d in range(20200101, 20200129))
TEXTS = {
    "plain": f"Notes, é\n\n, A, B\n{TABLE}\n\nAnnual\n20190101, 5.0\n20190102, 6\n",
    "windows": TABLE.replace("\n", "\r\n"),
    "starts at once": TABLE + "\n",
    "bad date": TABLE.replace("20200105", "20209999") + "\nend",
    "no table": "a,b\n1,2\n",
    "empty": "",
    "two breaks": f"2020, x\n{TABLE}\n,\n{TABLE}\n",
}


def rows(frame):
    key = lambda r: (r[0], r[1], r[2])
    return sorted(((os.path.basename(r.source).rsplit(".", 1)[0], str(r.date), r["at"], r.entity, r.value) for r in frame.collect()), key=key)


@pytest.fixture(scope="module")
def wanted(spark):
    return rows(texts.blocks(spark.createDataFrame(list(TEXTS.items()), "source string, content string")))


@pytest.mark.parametrize("split", [101, 300, 1 << 20])
def test_pieces(spark, tmp_path, wanted, split):
    for name, content in TEXTS.items():
        (tmp_path / f"{name}.csv").write_bytes(content.encode())
    assert rows(pieces.blocks(spark, str(tmp_path), split=split)) == wanted
    assert rows(pieces.blocks(spark, f"file://{tmp_path}/*.csv", split=split)) == wanted


def test_pieces_cover_all_lines_once(tmp_path):
    content = b"\n\nab\n" + b"x" * 50 + b"\n\ncd\r\nlast"
    (tmp_path / "f").write_bytes(content)
    starts = [0, *(i + 1 for i, c in enumerate(content) if c == 10)]
    whole = [(s, content[s:].split(b"\n")[0]) for s in starts]
    for split in range(1, 70):
        found = [line for at in range(0, len(content), split) for line in pieces.lines_of(f"{tmp_path}/f", at, at + split, chunk=5)]
        assert found == whole


def test_large_file_is_many_partitions_and_columns_are_pruned(spark, tmp_path):
    with open(tmp_path / "large.csv", "wb") as file:
        file.truncate(3 << 30)
    reader = pieces.BlockLinesReader(spark.createDataFrame([], pieces.MARKS).schema, {"path": str(tmp_path), "marks": "true"})
    assert len(reader.partitions()) == 48
    (tmp_path / "small.csv").write_text(TEXTS["plain"])
    batches = list(reader.read(pieces.Piece(f"{tmp_path}/small.csv", 0, 1 << 20)))
    assert [b.schema.names for b in batches] == [["source", "offset", "is_row"]]
    assert sum(b.num_rows for b in batches) == 3  # the first other line, the first row, and the line after the last row


def test_archives(spark, tmp_path, wanted):
    frame = spark.createDataFrame(list(TEXTS.items()), "source string, content string")
    assert storage.write_files(archives.packed(frame), str(tmp_path)) == len(TEXTS)
    assert rows(archives.blocks(spark, str(tmp_path))) == wanted


def test_archive_bytes_are_replaced_and_members_chosen(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("notes.txt", "20200101, 1\n")
        archive.writestr("Data.CSV", b"\xff\xfe\n20200102, 3, \xff\n")
        archive.writestr("other.csv", "20200103, 4\n")
    assert [(r.entity, r.value) for r in archives.blocks(spark, str(tmp_path)).orderBy("at").collect()] == [("C01", 0.03), ("C02", None)]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as archive:
        archive.writestr("notes.txt", "x")
    with pytest.raises(Exception, match="no .csv member"):
        archives.blocks(spark, str(tmp_path)).collect()


def sheet(days, start=datetime.date(2020, 1, 1)):
    return [[(start + datetime.timedelta(days=i)).isoformat(), float(i), None if i % 5 == 0 else i / 7] for i in range(days)]


def test_workbook(spark, tmp_path):
    head = [["About these factors"], [], ["date", "Value & Co", "Momentum"]]
    book = workbooks.written_book({"Notes": [["Nothing here"]] * 5, "Short": [["DATE", "x"], *sheet(20)], "Late": [["n"]] * 80 + [["DATE", "x"], *sheet(30)], "Real": head + sheet(40), "More": head + sheet(50)})
    (tmp_path / "f.xlsx").write_bytes(book)
    cells = workbooks.cells(spark, str(tmp_path))
    assert {r.sheet for r in cells.select("sheet").distinct().collect()} == {"Real"}
    wide = workbooks.wide(cells)
    assert wide.columns == ["date", "Value & Co", "Momentum"]
    assert sorted((r.date, float(r["Value & Co"]), None if r.Momentum is None else float(r.Momentum)) for r in wide.collect()) == [(a, b, c) for a, b, c in sheet(40)]
    series = texts.factor_series(wide, ("momentum",)).orderBy("date").collect()
    assert [(str(r.date), r.entity, r.ret) for r in series] == [(a, "Momentum", pytest.approx(c / 100)) for a, _, c in sheet(40) if c is not None]


def test_workbook_with_date_cells_and_inline_text(spark, tmp_path):
    """Dates as numbers in a date format, inline text, errors, booleans, no references, and columns without values."""
    space = workbooks._MAIN[1:-1]
    rows = ['<row><c t="inlineStr"><is><r><t>Mo</t></r><r><t>nth</t></r></is></c><c t="str"><v>ret</v></c><c t="inlineStr"><is><t>ret</t></is></c><c t="str"><v>none</v></c></row>']
    rows += [f'<row r="{i + 2}"><c r="A{i + 2}" s="1"><v>{43831 + i}</v></c><c r="B{i + 2}" s="2"><v>{i}</v></c><c r="C{i + 2}" t="e"><v>#N/A</v></c></row>' for i in range(30)]
    rows += ['<row r="40"><c r="C40" t="b"><v>1</v></c></row>']
    with zipfile.ZipFile(io.BytesIO(workbooks.written_book({"S": []}))) as plain, zipfile.ZipFile(tmp_path / "d.xlsx", "w") as archive:
        for name in plain.namelist():
            archive.writestr(name, f'<worksheet xmlns="{space}"><sheetData>{"".join(rows)}</sheetData></worksheet>' if "sheet1" in name else plain.read(name))
        archive.writestr("xl/styles.xml", f'<styleSheet xmlns="{space}"><numFmts count="1"><numFmt numFmtId="170" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
    found = workbooks.wide(workbooks.cells(spark, str(tmp_path)))
    assert found.columns == ["Month", "ret", "ret.1"]
    got = sorted((r.Month or "~", r.ret, r["ret.1"]) for r in found.collect())
    assert got[:2] == [("2020-01-01", "0", None), ("2020-01-02", "1", None)] and got[-1] == ("~", None, "1") and len(got) == 31


def test_unusable_workbook(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(workbooks.written_book({"S": [["DATE", "a"], *sheet(5)]}))
    with pytest.raises(Exception, match="no usable sheet"):
        workbooks.cells(spark, str(tmp_path)).collect()


def test_written_files_are_whole(spark, tmp_path):
    frame = spark.range(30).select(F.concat(F.lit("f"), "id").alias("name"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8").alias("content"))
    assert storage.write_files(frame, f"{tmp_path}/out") == 30 == storage.write_files(frame, f"{tmp_path}/out")
    assert [(os.path.basename(p), n) for p, n in sorted(storage.found(f"{tmp_path}/out"), key=lambda x: x[1])] == [(f"f{i}", i) for i in range(30)]
