"""What the training-data operators share: tables, word rules, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelspark.tables import shared_dir, written

__all__ = ["ascii_lower", "first_rows", "keyed_rows", "row_hashes", "shared_dir", "small_batches", "table", "text_or_empty", "without_rows", "written"]

#: Java patterns of the separators between words.
SPACE = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, so that very long texts fit a Python worker (a single
    text beyond the bytes is a batch of its own). This sets the session for what runs after it as well."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def row_hashes() -> list[Column]:
    """id_hash and text_hash of a row: what tells rows apart where doc_id repeats or is null."""
    return [F.xxhash64("doc_id").alias("id_hash"), F.xxhash64("text").alias("text_hash")]


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns), id_hash and text_hash of every row of ``docs``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_hashes())


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id_hash and text_hash aren't both those of a row of ``gone``; all columns stay."""
    gone = gone.select("id_hash", "text_hash").distinct()
    return keyed_rows(docs).join(gone, ["id_hash", "text_hash"], "left_anti").select("row.*")


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group: the ``first`` of ``grouped``, which has the id_hash and text_hash
    of every row and of the first one of its group. All columns stay."""
    first = (F.col("id_hash") == F.col("first.id_hash")) & (F.col("text_hash") == F.col("first.text_hash"))
    kept = written(grouped.filter(first).groupBy("id_hash", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "kept-rows")
    found = keyed_rows(docs).join(kept, ["id_hash", "text_hash"])
    # rows that are equal in both are told apart by a number; the others need none
    equal = Window.partitionBy("id_hash", "text_hash").orderBy(F.xxhash64(F.to_json("row")))
    repeated = found.filter("copies > 1").withColumn("nth", F.row_number().over(equal)).filter("nth = 1")
    return found.filter("copies = 1").select("row.*").unionByName(repeated.select("row.*"))
