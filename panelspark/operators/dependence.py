"""Dependence of a panel: mean correlation of its entities, and the summary of a date series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.aggregate import KEYS
from panelspark.operators.portfolio import same_date_correlation
from panelspark.operators.series import autocorrelation, effective_size


def mean_correlation(panel: DataFrame, least: int = 10) -> DataFrame:
    """panel_id and the mean correlation of all pairs of entities that have a return on every date (at least
    ``least``) and any spread; 0 without such a pair.

    With series of mean 0 and unit length, the sum over all pairs is half of what the squared sums by
    date exceed the number of series by: no pairs are made."""
    rows = panel.select("panel_id", "t_idx", "e_idx", "realised")
    own = Window.partitionBy("panel_id", "e_idx")
    dates = rows.groupBy("panel_id").agg(F.countDistinct("t_idx").alias("dates"))
    rows = rows.join(F.broadcast(dates), "panel_id").withColumn("n", F.count("realised").over(own)).filter((F.col("n") == F.col("dates")) & (F.col("n") >= least))
    rows = rows.withColumn("x", F.col("realised") - F.avg("realised").over(own))
    rows = rows.withColumn("length", F.sqrt(F.sum(F.col("x") * F.col("x")).over(own))).filter("length > 0")
    by_date = rows.groupBy("panel_id", "t_idx").agg(F.sum(F.col("x") / F.col("length")).alias("s"), F.count(F.lit(1)).alias("entities"))
    found = by_date.groupBy("panel_id").agg(F.sum(F.col("s") * F.col("s")).alias("squares"), F.max("entities").alias("entities"))
    m = F.col("entities")
    found = found.select("panel_id", F.when(m > 1, (F.col("squares") - m) / (m * (m - 1))).alias("mean"))
    return panel.select("panel_id").distinct().join(found, "panel_id", "left").select("panel_id", F.coalesce("mean", F.lit(0.0)).alias("cross_sectional_corr"))


def pairwise_correlation(panel: DataFrame, least: int = 10) -> DataFrame:
    """The same over the dates that both entities of a pair have, ``least`` or more; null without such a pair."""
    there = F.when(F.col("realised").isNotNull(), 1.0)
    every = same_date_correlation(panel.withColumn("conf", there).withColumn("pred", there), (0.0,), least)
    return every.select("panel_id", F.col("rho_same_date").alias("pairwise_corr"))


def dependence_summary(panel: DataFrame, series: DataFrame) -> DataFrame:
    """n_nominal, n_effective, their ratios, autocorrelations at 1, 5 and 10 (0 beyond the series), and the mean correlation."""
    rho = autocorrelation(series).groupBy(*KEYS).agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("rho"))), F.lit(0.0)).alias(f"acf_lag{k}") for k in (1, 5, 10)))
    rows = effective_size(series).join(rho, list(KEYS)).join(F.broadcast(mean_correlation(panel)), "panel_id")
    return rows.select(
        *KEYS, F.col("n").alias("n_nominal"), F.col("n_eff").alias("n_effective"), (F.col("n_eff") / F.col("n")).alias("n_eff_ratio"),
        (F.col("n") / F.col("n_eff")).alias("inflation_ratio"), "acf_lag1", "acf_lag5", "acf_lag10", "cross_sectional_corr",
    )
