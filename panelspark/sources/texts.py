"""Panels and factors from text files: tables in fixed blocks, prices by symbol, factor series, a registry.

A file is one row (source, content): files are small, and many of them are read side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.special import finite
from panelspark.operators.panel import dense_grid, last_dates, simple_returns

#: Numbers that stand for "missing".
SENTINELS = (-99.99, -999.0)
#: Names of a date column, in capitals.
DATE_LABELS = ("DATE", "MONTH")
REGISTRY_SCHEMA = """version int, created_for string, default_thresholds array<double>, candidates array<struct<id string, family string, description string,
  loader string, candidate_type string, periodicity string, annualization_factor double, source_url string, portfolio_url string, lookback int, skip int,
  sample_tail int, thresholds array<double>, primary_threshold double, symbols array<string>, groups array<string>, preferred_columns array<string>>>"""


class SourceError(ValueError):
    """A source that doesn't hold what it should."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """source (the path) and content of each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("content"))


def without_sentinels(value: Column, sentinels: tuple[float, ...] = SENTINELS) -> Column:
    """``value``, with sentinels, NaN and infinities as null."""
    return finite(F.when(~value.isin(*sentinels), value))


def _fields(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda x: F.trim(x))


def blocks(texts: DataFrame, prefix: str = "C", first: int = 1) -> DataFrame:
    """source, date, at, entity (``prefix`` and the column's number in two digits, from ``first``) and value of
    the first table of each file.

    The table starts with the first line whose first field is eight digits and ends before the next one
    whose isn't. Values are per cent; sentinels and what is no number are null, and so are lines
    whose date doesn't exist: they have no row."""
    lines = texts.select("source", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line")).withColumn("fields", _fields(F.col("line")))
    is_row = F.get("fields", F.lit(0)).rlike("^[0-9]{8}$")
    before = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.min(F.when(is_row, F.col("line_no"))).over(before)
    stop = F.min(F.when(~is_row & (F.col("line_no") > F.col("start")), F.col("line_no"))).over(before)
    table = lines.withColumn("start", start).withColumn("stop", stop).filter(F.col("start").isNotNull() & F.col("stop").isNull())
    return cell_values(table.select("source", F.get("fields", F.lit(0)).alias("date"), F.slice("fields", 2, F.size("fields") - 1).alias("cells")), prefix, first)


def cell_values(rows: DataFrame, prefix: str, first: int) -> DataFrame:
    """source, date, at, entity and value of a table's rows (source, date and cells as text)."""
    date = F.try_to_timestamp("date", F.lit("yyyyMMdd")).cast("date")
    cells = rows.select("source", date.alias("date"), F.posexplode("cells").alias("at", "text")).filter("date is not null")
    name = F.concat(F.lit(prefix), F.lpad((F.col("at") + first).cast("string"), 2, "0"))
    return cells.select("source", "date", "at", name.alias("entity"), (without_sentinels(F.col("text").try_cast("double")) / 100).alias("value"))


def portfolio_returns(texts: DataFrame, panel_id: str, prefix: str = "P", first: int = 0, tail: int = 0) -> DataFrame:
    """RETURNS of a file of portfolios: dates on which none has a value are left out, then all but the last ``tail``."""
    return returns_of_blocks(blocks(texts, prefix, first), panel_id, tail)


def returns_of_blocks(found: DataFrame, panel_id: str, tail: int = 0) -> DataFrame:
    """The same from what :func:`blocks`, or another reader of tables, gives."""
    cells = found.filter("value is not null").select(F.lit(panel_id).alias("panel_id"), "date", "entity", "value")
    return last_dates(dense_grid(cells).withColumnRenamed("value", "ret"), tail)


def factor_table(factors: DataFrame, momentum: DataFrame) -> DataFrame:
    """FACTORS (date, mkt_rf, smb, hml, rf, mom) from the first four columns of one file's table and the
    first of another's; dates without any value are left out."""
    column = lambda i: F.max(F.when(F.col("at") == i, F.col("value")))
    base = blocks(factors).groupBy("date").agg(*(column(i).alias(c) for i, c in enumerate(("mkt_rf", "smb", "hml", "rf"))))
    return joined_factors(base, blocks(momentum).filter("at = 0").groupBy("date").agg(F.max("value").alias("mom")))


def joined_factors(base: DataFrame, momentum: DataFrame) -> DataFrame:
    """The factors with momentum where it has the date; rows without any value are left out."""
    return base.join(momentum, "date", "left").dropna("all", subset=[c for c in base.columns + momentum.columns if c != "date"])


def prices(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbol, date and close from files with Date and Close columns (``texts``: source is the symbol), and
    the symbols that have no such columns, with a note each."""
    lines = texts.select("source", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line")).withColumn("fields", _fields(F.col("line")))
    head = lines.filter("line_no = 0").select("source", F.array_position("fields", "Date").alias("date_at"), F.array_position("fields", "Close").alias("close_at"))
    bad = (F.col("date_at") == 0) | (F.col("close_at") == 0)
    notes = head.filter(bad).select(F.col("source").alias("symbol"), F.lit("missing Date/Close columns").alias("note"))
    found = lines.filter("line_no > 0").join(head.filter(~bad), "source").select(
        F.col("source").alias("symbol"),
        F.try_to_timestamp(F.get("fields", F.col("date_at").cast("int") - 1)).cast("date").alias("date"),
        F.get("fields", F.col("close_at").cast("int") - 1).try_cast("double").alias("close"),
    )
    return found.filter("date is not null and close is not null"), notes


def price_returns(found: DataFrame, panel_id: str, least: int = 3, tail: int = 0) -> DataFrame:
    """RETURNS of prices (symbol, date, close) on the calendar of all symbols: no return where a symbol has no
    price on the date or the one before; dates without any return are left out."""
    if found.select("symbol").distinct().count() < least:
        raise SourceError(f"fewer than {least} series")
    values = found.select(F.lit(panel_id).alias("panel_id"), "date", F.col("symbol").alias("entity"), F.col("close").alias("value"))
    some = simple_returns(dense_grid(values)).filter("ret is not null").select("panel_id", "date", "entity", F.col("ret").alias("value"))
    return last_dates(dense_grid(some).withColumnRenamed("value", "ret"), tail)


def dropna_columns(frame: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` that have any value: one pass over the rows."""
    counts = frame.select(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if counts[f"n{i}"]]


def factor_series(wide: DataFrame, preferred: tuple[str, ...] = (), least: int = 30) -> DataFrame:
    """date, entity and ret of one column of a wide table of text.

    The date column is the first one that is named so, or the table's first, of which over half the rows
    (and over 20) are dates. The value column is the first whose name holds the first of ``preferred``
    that any name does, else the first with a number; per cent if its median size is above 1."""
    quoted = lambda c: F.col(f"`{c}`")
    parsed = lambda c: F.try_to_timestamp(F.trim(quoted(c).cast("string"))).cast("date")
    number = lambda c: quoted(c).cast("string").try_cast("double")
    labels = [c for i, c in enumerate(wide.columns) if c.strip().upper() in DATE_LABELS or i == 0]
    counts = wide.select(F.count(F.lit(1)).alias("rows"), *(F.count(parsed(c)).alias(f"n{i}") for i, c in enumerate(labels))).first()
    dates = [c for i, c in enumerate(labels) if counts[f"n{i}"] > max(20, counts["rows"] // 2)]
    if not dates:
        raise SourceError("no date column")
    numbers = wide.select(parsed(dates[0]).alias("date"), *(number(c).alias(c) for c in wide.columns if c != dates[0]))
    columns = dropna_columns(numbers, [c for c in numbers.columns if c != "date"])
    if not columns:
        raise SourceError("no numeric column")
    wanted = [[c for c in columns if w.lower() in c.lower()] for w in preferred]
    chosen = next((m[0] for m in wanted if m), columns[0])
    rows = numbers.dropna("all", subset=[f"`{c}`" for c in columns]).select("date", quoted(chosen).alias("value"))
    middle = rows.agg(F.median(F.abs("value"))).first()[0] or 0.0
    out = rows.select("date", F.lit(chosen.strip()).alias("entity"), finite(F.col("value") / (100.0 if middle > 1 else 1.0)).alias("ret")).filter("ret is not null")
    if out.count() < least:
        raise SourceError(f"fewer than {least} usable rows")
    return out


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A row for each candidate of a registry file, its thresholds the file's where it has none."""
    found = spark.read.schema(REGISTRY_SCHEMA).json(path, multiLine=True)
    rows = found.select("default_thresholds", F.explode("candidates").alias("c")).select("default_thresholds", "c.*")
    return rows.withColumn("thresholds", F.coalesce("thresholds", "default_thresholds")).drop("default_thresholds")


def loaded(spec: dict, loaders: dict[str, Callable[[dict], DataFrame]]) -> DataFrame:
    """What the loader that a candidate names makes of it."""
    if spec.get("loader") not in loaders:
        raise SourceError(f"unknown source loader: {spec.get('loader')}")
    return loaders[spec["loader"]](spec)


def write_table(frame: DataFrame, path: str, kind: str = "csv", by: str | None = None) -> None:
    """Write as csv (with a header), json or parquet, over what is there; in folders by a column, if one is named."""
    writer = frame.write.mode("overwrite")
    writer = writer.partitionBy(by) if by else writer
    writer = writer.option("header", True) if kind == "csv" else writer
    writer.format(kind).save(path)


def as_json(frame: DataFrame) -> DataFrame:
    """A row of JSON text for each row, keys in order."""
    return frame.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(frame.columns)))).alias("value"))


def read_json(text: str) -> dict:
    """One JSON object."""
    return json.loads(text)


def provenance(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("csv", "json", "md")) -> DataFrame:
    """path, bytes and sha256 of the files under ``path`` with these suffixes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = reduce(lambda a, b: a | b, (F.col("path").endswith(f".{s}") for s in suffixes))
    return found.filter(kept).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def head(returns: DataFrame, rows: int = 20) -> DataFrame:
    """The first dates of RETURNS."""
    return returns.filter(F.col("t_idx") < rows)
