"""Value panels (panel_id, date, entity, value) from the warehouse tables.

Money is added as decimals, so a cell's value doesn't depend on the order in which
Spark adds its rows. The scans read only the columns named here, and the fact table is
reduced to one row a (date, entity) before anything else happens to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the warehouse tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(amount: Column) -> Column:
    """A sum of money that is the same in whatever order it is added."""
    return F.sum(amount.cast("decimal(18,4)")).cast("double")


def ship_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of the suppliers' nations by week of shipment."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(suppliers, "s_suppkey")
        .groupBy(F.lit("ship_week").alias("panel_id"), "date", F.col("s_nationkey").alias("entity"))
        .agg(exact_sum(F.col("amount")).alias("value"))
    )


def order_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of the customers' nations by month."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.date_trunc("month", "o_orderdate").cast("date").alias("date"), "o_totalprice"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customers, "c_custkey")
        .groupBy(F.lit("order_month").alias("panel_id"), "date", F.col("c_nationkey").alias("entity"))
        .agg(exact_sum(F.col("o_totalprice")).alias("value"))
    )


def event_day(spark: SparkSession, sf_dir: str, entities: int = 5) -> DataFrame:
    """Event values of user groups by day."""
    events = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"), F.pmod("user_id", F.lit(entities)).cast("int").alias("entity"), "value"
    )
    return events.groupBy(F.lit("event_day").alias("panel_id"), "date", "entity").agg(exact_sum(F.col("value")).alias("value"))
