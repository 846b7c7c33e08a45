"""A stream of events (ts, user_id, value) into closed days and sessions.

A day is closed when the watermark, the latest event less ``delay``, has passed its end; what comes later
for it is dropped and counted by the query (:func:`late_rows`). Days are appended once, as one row with all of
their entities, so that whoever reads them has a date whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: What a closed day is.
CLOSED = "panel_id string, date date, cells array<struct<entity:int,value:double>>"


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The events of parquet files under ``path`` (which may be a pattern), new files as they come; at most ``files`` at once."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def heartbeat(spark: SparkSession, path: str, at: str) -> None:
    """Write an event without user and value, dated ``at``: it closes all that ends by then, and adds nothing."""
    row = spark.createDataFrame([(None, None, None, None, None)], "event_id long, user_id long, event_type string, value double, props string")
    row.select("event_id", F.lit(at).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(path)


def on_the_clock(frame: DataFrame) -> DataFrame:
    """``ts`` as an instant whose UTC clock shows the event's: windows are aligned by UTC, watermarks want instants."""
    return frame.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def clock(instant: Column | str) -> Column:
    """The clock time of such an instant."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def amount(value: Column) -> Column:
    """A sum of decimals: the same in whatever batches the rows come."""
    return F.sum(value.cast("decimal(18,4)"))


def closed_days(events: DataFrame, entities: int = 5, delay: str = "1 day", panel_id: str = "event_day") -> DataFrame:
    """panel_id, date and cells (entity, value; by entity) of every day with events, once it is closed.

    Two aggregations in a row, so only one sum for each entity and day leaves a task for the day's row."""
    # heartbeats go through the aggregations: a filter below would be pushed under the watermark
    seen = on_the_clock(events).withWatermark("ts", delay)
    of_entity = seen.groupBy(F.window("ts", "1 day"), F.pmod("user_id", F.lit(entities)).cast("int").alias("entity")).agg(amount(F.col("value")).cast("double").alias("value"))
    cell = F.when(F.col("entity").isNotNull(), F.struct("entity", "value"))
    whole = of_entity.groupBy(F.window("window", "1 day")).agg(F.array_sort(F.collect_list(cell)).alias("cells")).filter(F.size("cells") > 0)
    return whole.select(F.lit(panel_id).alias("panel_id"), F.to_date(clock("window.start")).alias("date"), "cells")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """user_id, first and last (the session's first event, and ``gap`` after its last one), n and value of each user's
    sessions: events with less than ``gap`` between neighbours. In a stream a session comes once it is closed."""
    seen = on_the_clock(events).withWatermark("ts", delay)
    found = seen.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("user_id").alias("n"), amount(F.col("value")).cast("double").alias("value"))
    return found.filter("n > 0").select("user_id", clock("s.start").alias("first"), clock("s.end").alias("last"), "n", "value")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped because they came after the watermark (as partly aggregated, in those batches that are still remembered)."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
