"""A store of result tables in folders by candidate: written with checks, read back, and gone on with after an interruption.

A table's write replaces the folders of the candidates it has rows for and leaves the others; the
folders are there all or not at all, so a candidate that a table has is finished for that table. The rules
of a table are counted by ``DataFrame.observe`` while it is written: nothing is read again for them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CANDIDATE = "candidate_id"
VIOLATIONS = "table string, rule string, rows long"


def path_of(store: str, table: str) -> str:
    """The folder of a table."""
    return f"{store.rstrip('/')}/{table}"


def save(frame: DataFrame, store: str, table: str, rules: dict[str, Column] | None = None) -> list[tuple[str, str, int]]:
    """Write the rows of a table by ``candidate_id``; (table, rule, rows) of what breaks a rule (a column that is true
    for it), and of a table without rows."""
    rules, seen = rules or {}, Observation(f"{table}-{uuid.uuid4().hex}")
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())]
    counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(CANDIDATE).parquet(path_of(store, table))
    found = seen.get
    broken = [(table, rule, found[f"r{i}"]) for i, rule in enumerate(rules) if found[f"r{i}"]]
    return broken if found["rows"] else [*broken, (table, "empty", 0)]


def load(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    """A table, or nothing where it hasn't been written. Candidates' names are text, whatever they look like."""
    with_text = spark.read.option("recursiveFileLookup", "false")
    try:
        found = with_text.parquet(path_of(store, table))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found.withColumn(CANDIDATE, F.col(CANDIDATE).cast("string"))


def unfinished(spark: SparkSession, store: str, table: str, work: DataFrame) -> DataFrame:
    """The rows of ``work`` (with candidate_id) whose candidates the table doesn't have: an anti join with its folders' names."""
    done = load(spark, store, table)
    return work if done is None else work.join(done.select(CANDIDATE).distinct(), CANDIDATE, "left_anti")


def required(frame: DataFrame, nullable: tuple[str, ...] = ()) -> dict[str, Column]:
    """Rules against infinite numbers anywhere and missing ones outside ``nullable``."""
    doubles = [c for c, t in frame.dtypes if t in ("double", "float")]
    numbers = [c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint") and c not in nullable]
    rules = {f"infinite {c}": F.abs(F.col(c)) == float("inf") for c in doubles}
    return rules | {f"missing {c}": F.col(c).isNull() | (F.isnan(c) if c in doubles else F.lit(False)) for c in numbers}


def missing(spark: SparkSession, store: str, tables: tuple[str, ...], work: DataFrame) -> list[tuple[str, str, int]]:
    """(table, rule, rows) for the candidates of ``work`` that a table doesn't have."""
    counts = [(t, "missing candidate", unfinished(spark, store, t, work).count()) for t in tables]
    return [c for c in counts if c[2]]
