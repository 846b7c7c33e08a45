"""Intermediate tables, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is named, a local session gets
    one of its own; on a cluster, where others would not see it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        # the setting can't be changed in a running session
        named = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="panelspark-")
        _OWN[spark.sparkContext.applicationId] = named
    return named


def new_dir(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and
    a lost executor costs no recomputation of what stands above."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What ``make`` gives, written, and its folder. The tables that ``make`` has written on the way, which only that result was
    read from, are deleted; after a failure they stay."""
    _scopes.append([])
    try:
        found = written(make(), label)
        *others, path = _scopes[-1]
    finally:
        _scopes.pop()
    for other in others:
        removed(spark, other)
    return found, path


def spread(work: DataFrame, *keys: str) -> DataFrame:
    """``work`` by keys over a fixed number of partitions, some for each core: little data with much to compute,
    which adaptive execution would put together by its size."""
    return work.repartition(4 * int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
