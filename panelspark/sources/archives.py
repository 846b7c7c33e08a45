"""Text tables within zip archives, unpacked by the tasks that read them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.pieces import is_row
from panelspark.sources.storage import opened
from panelspark.sources.texts import SourceError, cell_values

ROWS = 1 << 14


def paths(spark: SparkSession, path: str) -> DataFrame:
    """path of the files under ``path`` (a folder or a pattern): their content isn't read."""
    return spark.read.format("binaryFile").load(path).select("path")


def first_member(archive: zipfile.ZipFile, suffix: str) -> str:
    """The first member whose name ends so, in any case."""
    name = next((n for n in archive.namelist() if n.lower().endswith(suffix)), None)
    if name is None:
        raise SourceError(f"no {suffix} member in the archive")
    return name


def table_lines(lines: Iterator[str]) -> Iterator[str]:
    """The lines of the first table: from the first row to the next line that is none."""
    inside = False
    for line in lines:
        row = is_row(line)
        if inside and not row:
            return
        inside = inside or row
        if inside:
            yield line


def unpacked(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """source, date and cells (text) of the rows of the first table in the first ``suffix`` member of each archive.

    A task unpacks its archives piece by piece and ends each with its table; bytes that are no UTF-8 become replacement
    characters. Many archives are many tasks; one archive can't be split."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["source", "date", "cells"])

        for batch in batches:
            for source in batch["path"]:
                system, own = opened(source)
                rows = []
                with system.open_input_file(own) as file, zipfile.ZipFile(file) as archive, archive.open(first_member(archive, suffix)) as member:
                    for line in table_lines(io.TextIOWrapper(member, encoding="utf-8", errors="replace")):
                        fields = [x.strip() for x in line.split(",")]
                        rows.append((source, fields[0], fields[1:]))
                        if len(rows) >= ROWS:
                            yield frame(rows)
                            rows = []
                if rows:
                    yield frame(rows)

    return paths(spark, path).mapInPandas(unpack, "source string, date string, cells array<string>")


def blocks(spark: SparkSession, path: str, prefix: str = "C", first: int = 1) -> DataFrame:
    """source, date, at, entity and value of the first table of each archive, as ``texts.blocks`` gives them."""
    return cell_values(unpacked(spark, path), prefix, first)


def packed(texts: DataFrame, member: str = "table.csv") -> DataFrame:
    """name (``source``.zip) and content: each text (source, content) as an archive of one member."""

    @F.pandas_udf("binary")
    def pack(contents: pd.Series) -> pd.Series:
        out = []
        for content in contents:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("readme.txt", "notes")
                archive.writestr(member, content)
            out.append(held.getvalue())
        return pd.Series(out)

    return texts.select(F.concat("source", F.lit(".zip")).alias("name"), pack("content").alias("content"))
