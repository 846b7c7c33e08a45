"""The queries of the stream, each from one table of files to the next, with a checkpoint of its own.

    events -> days -> dates -> summaries

A run takes all that is there and ends (available-now); the next run goes on from the checkpoints. Tables are
written exactly once: days and dates by the file sink's log, summaries in a folder for each
micro-batch, which a repeated one overwrites.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from panelspark.streaming import events, returns


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting, for as long as it is needed."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def finished(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Run a query on all that is there; its state is kept by RocksDB, on disk and as changes in the checkpoint."""
    with setting(spark, *returns.PROVIDER):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def to_files(frame: DataFrame, work_dir: str, name: str) -> DataStreamWriter:
    """Append to the table ``name``."""
    return frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{work_dir}/checkpoints/{name}").option("path", f"{work_dir}/{name}")


def one_file(frame: DataFrame) -> DataFrame:
    """Rows for one file a micro-batch, so that the order of files is that of batches. They are shuffled to its task: only
    put together, all of the query's state would be gone through there as well."""
    return frame.repartition(1)


def event_source(spark: SparkSession, path: str, files: int | None, beats: str | None) -> DataFrame:
    """The events under ``path`` with the heartbeats under ``beats``, if there are any."""
    seen = events.event_stream(spark, path, files)
    return seen.unionByName(events.event_stream(spark, beats)) if beats else seen


def close_days(spark: SparkSession, path: str, work_dir: str, files: int | None = None, entities: int = 5, delay: str = "1 day", beats: str | None = None) -> StreamingQuery:
    """Append the days that the events under ``path``, and the heartbeats under ``beats``, have closed to ``days``."""
    seen = event_source(spark, path, files, beats)
    return finished(spark, to_files(one_file(events.closed_days(seen, entities, delay)), work_dir, "days"))


def close_sessions(
    spark: SparkSession, path: str, work_dir: str, files: int | None = None, gap: str = "30 minutes", delay: str = "1 day", beats: str | None = None
) -> StreamingQuery:
    """Append the sessions that the events under ``path``, and the heartbeats under ``beats``, have closed to ``sessions``,
    a file from each task that holds users."""
    seen = event_source(spark, path, files, beats)
    return finished(spark, to_files(events.sessions(seen, gap, delay), work_dir, "sessions"))


def take_days(spark: SparkSession, work_dir: str, thresholds: tuple[float, ...], lookback: int, skip: int, files: int | None = None) -> StreamingQuery:
    """Append the date returns that ``days`` gives to ``dates``."""
    reader = spark.readStream.schema(events.CLOSED)
    days = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{work_dir}/days")
    return finished(spark, to_files(one_file(returns.date_returns(days, thresholds, lookback, skip)), work_dir, "dates"))


def summarise(spark: SparkSession, work_dir: str, annualise: float, files: int | None = None, source: str = "dates") -> StreamingQuery:
    """Write the summaries after each micro-batch of ``source`` to ``summaries``."""
    reader = spark.readStream.schema(returns.RETURNS)
    dates = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{work_dir}/{source}")

    def keep(batch: DataFrame, number: int) -> None:
        one_file(batch).write.mode("overwrite").parquet(f"{work_dir}/summaries/batch={number}")

    writer = returns.running_summary(dates, annualise).writeStream.outputMode("update").foreachBatch(keep)
    return finished(spark, writer.option("checkpointLocation", f"{work_dir}/checkpoints/summaries"))


def latest(spark: SparkSession, work_dir: str) -> DataFrame:
    """The last summary of each series."""
    newest = Window.partitionBy("panel_id", "threshold").orderBy(F.desc("batch"))
    found = spark.read.parquet(f"{work_dir}/summaries").withColumn("nth", F.row_number().over(newest))
    return found.filter("nth = 1").drop("nth", "batch")


def replay(spark: SparkSession, path: str, work_dir: str, thresholds: tuple[float, ...], lookback: int, skip: int, annualise: float, until: str, entities: int = 5) -> DataFrame:
    """All events under ``path`` through the three queries, all days up to ``until`` closed: the last summaries."""
    events.heartbeat(spark, f"{work_dir}/heartbeat", until)
    close_days(spark, path, work_dir, entities=entities, beats=f"{work_dir}/heartbeat")
    take_days(spark, work_dir, thresholds, lookback, skip)
    summarise(spark, work_dir, annualise)
    return latest(spark, work_dir)
