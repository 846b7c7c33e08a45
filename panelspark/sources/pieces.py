"""Large text files with a table in a fixed block, read in pieces by a data source of Spark.

``spark.read.format("block_lines")`` gives a partition for each ``split`` bytes of each file and a row for each line
that starts in it: source, offset (of its first byte), is_row (its first field is eight digits), date and cells (its
fields, as text; only for rows). Columns that the reader's schema leaves out are not made. With ``marks`` set it
gives only the lines where a table can begin or end within the piece.

A file's first table is then the rows from its first one up to the first other line after that, found
from the marks of all pieces together: no task reads more than a piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from panelspark.sources.storage import found, opened
from panelspark.sources.texts import cell_values
from panelspark.tables import written

SPLIT, ROWS = 64 << 20, 1 << 14
SCHEMA = "source string, offset long, is_row boolean, date string, cells array<string>"
MARKS = "source string, offset long, is_row boolean"
_KINDS = {"source": pa.string(), "offset": pa.int64(), "is_row": pa.bool_(), "date": pa.string(), "cells": pa.list_(pa.string())}
_DATE = re.compile("[0-9]{8}")


@dataclass
class Piece(InputPartition):
    """Bytes ``start`` up to ``end`` of a file."""

    path: str
    start: int
    end: int


def lines_of(path: str, start: int, end: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that start within these bytes, the last one to its end."""
    system, own = opened(path)
    with system.open_input_file(own) as file:
        # the line that a piece's first byte belongs to is the piece's own only if it starts there
        at = max(start - 1, 0)
        file.seek(at)
        rest, skip = b"", start > 0
        while True:
            more = file.read(chunk)
            lines = (rest + more).split(b"\n")
            rest = lines.pop() if more else b""
            for line in lines if more else [b"\n".join(lines)]:
                if skip:
                    skip = False
                elif at < end and (more or line):
                    yield at, line
                at += len(line) + 1
                if at >= end:
                    return
            if not more:
                return


def is_row(line: str) -> bool:
    """Whether a line's first field is eight digits."""
    return bool(_DATE.fullmatch(line.partition(",")[0].strip()))


class BlockLinesReader(DataSourceReader):
    """Reads the columns of a schema from the pieces of files."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.fieldNames()
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.marks = str(options.get("marks", "false")).lower() == "true"

    def partitions(self) -> list[Piece]:
        """The pieces of all files: only names and sizes are looked at."""
        return [Piece(path, at, min(at + self.split, size)) for path, size in found(self.path) for at in range(0, size, self.split)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """Batches of a piece's lines."""
        rows, seen, before = [], set(), None
        for offset, raw in lines_of(partition.path, partition.start, partition.end):
            line = raw.decode("utf-8", errors="replace")
            row = is_row(line)
            if not self.marks or row not in seen or (before and not row):
                fields = [x.strip() for x in line.split(",")] if row and not self.marks else None
                rows.append((partition.path, offset, row, fields and fields[0], fields and fields[1:]))
            seen.add(row)
            before = row
            if len(rows) >= ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        made = dict(zip(_KINDS, zip(*rows, strict=True), strict=True))
        return pa.record_batch([pa.array(made[c], type=_KINDS[c]) for c in self.columns], names=self.columns)


class BlockLines(DataSource):
    """The format ``block_lines``."""

    @classmethod
    def name(cls) -> str:
        """The format's name."""
        return "block_lines"

    def schema(self) -> str:
        """All columns."""
        return SCHEMA

    def reader(self, schema: StructType) -> BlockLinesReader:
        """A reader of the wanted columns."""
        return BlockLinesReader(schema, self.options)


def blocks(spark: SparkSession, path: str, prefix: str = "C", first: int = 1, split: int = SPLIT) -> DataFrame:
    """source, date, at, entity and value of the first table of each file, as ``texts.blocks`` gives them, for files of any size.

    Bounds are one row a file, joined with its lines: beside them where they are few (by Spark's own limit), else by source."""
    spark.dataSource.register(BlockLines)
    reader = spark.read.format("block_lines").option("path", path).option("split", split)
    marks = written(reader.schema(MARKS).option("marks", "true").load(), "block-marks")
    starts = marks.filter("is_row").groupBy("source").agg(F.min("offset").alias("start"))
    stops = marks.filter("NOT is_row").join(starts, "source").filter("offset > start").groupBy("source").agg(F.min("offset").alias("stop"))
    bounds = written(starts.join(stops, "source", "left"), "block-bounds")
    lines = spark.read.format("block_lines").option("path", path).option("split", split).load().filter("is_row")
    inside = lines.join(bounds, "source").filter("offset >= start AND (stop IS NULL OR offset < stop)")
    return cell_values(inside.select("source", "date", "cells"), prefix, first)
