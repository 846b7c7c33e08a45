"""From the panel to one return a date, and summaries of these.

DATE_RETURNS  panel_id, threshold, t_idx, date, ret (null: nothing selected), n_sel
SERIES        panel_id, threshold, u (dense from 0 over dates with a return), r
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.special import sign

KEYS = ("panel_id", "threshold")


def selected(threshold: float) -> Column:
    """Whether a row of PANEL is in the portfolio of a threshold."""
    return (F.col("conf") >= F.lit(threshold)) & F.col("realised").isNotNull() & F.col("pred").isNotNull()


def weight(weighting: str) -> Column:
    """equal: 1; confidence and custom (column ``weight``): not below 0; signal_abs: size of the signal."""
    return {
        "equal": F.lit(1.0),
        "confidence": F.greatest(F.col("conf"), F.lit(0.0)),
        "signal_abs": F.abs("pred"),
        "custom": F.greatest(F.col("weight") if weighting == "custom" else F.lit(0.0), F.lit(0.0)),
    }[weighting]


def date_returns(
    panel: DataFrame, thresholds: tuple[float, ...], weighting: str = "equal", exposure: str = "as_selected", by: tuple[str, ...] = ("panel_id",)
) -> DataFrame:
    """DATE_RETURNS of all thresholds in one pass: conditional sums, one exchange on the date.

    ``as_selected`` is the weighted mean of what is selected; ``dollar_neutral`` half that
    of the long and half that of the short side, and needs both."""
    w = weight(weighting)

    def mean(where: Column) -> Column:
        held = F.sum(F.when(where, w))
        return F.try_divide(F.sum(F.when(where, w * F.col("realised"))), F.nullif(held, F.lit(0.0)))

    def of(threshold: float) -> Column:
        here = selected(threshold)
        if exposure == "as_selected":
            ret = mean(here)
        elif exposure == "dollar_neutral":
            ret = 0.5 * mean(here & (F.col("pred") > 0)) + 0.5 * mean(here & (F.col("pred") < 0))
        else:
            raise ValueError(f"unknown exposure {exposure}")
        return F.struct(F.lit(threshold).alias("threshold"), ret.alias("ret"), F.count_if(here).alias("n_sel"))

    one_a_date = panel.groupBy(*by, "t_idx", "date").agg(F.array(*(of(x) for x in thresholds)).alias("all"))
    return one_a_date.select(*by, "t_idx", "date", F.explode("all").alias("x")).select(*by, "x.threshold", "t_idx", "date", "x.ret", "x.n_sel")


def series_of(dates: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """SERIES: the dates that have a return, renumbered without gaps."""
    u = F.row_number().over(Window.partitionBy(*keys).orderBy("t_idx")) - 1
    return dates.filter("ret is not null").select(*keys, u.alias("u"), F.col("ret").alias("r"))


def sharpe_of(value: Column, annualise: float) -> Column:
    """mean / sd (n - 1) x sqrt(annualise); 0 for fewer than two values or no spread."""
    spread = F.stddev_samp(value)
    return F.coalesce(F.when(spread > 0, F.avg(value) / spread * F.sqrt(F.lit(float(annualise)))), F.lit(0.0))


def threshold_sharpe(dates: DataFrame, annualise: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n_dates, avg_names (over dates with any), mean, sd and sharpe of each series."""
    return dates.groupBy(*keys).agg(
        F.count("ret").alias("n_dates"),
        F.avg(F.when(F.col("n_sel") > 0, F.col("n_sel"))).alias("avg_names"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("sd"),
        sharpe_of(F.col("ret"), annualise).alias("sharpe"),
    )


def selected_counts(panel: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Names a date whose confidence reaches the threshold and that have a return."""
    here = lambda x: F.count_if((F.col("conf") >= F.lit(x)) & F.col("realised").isNotNull())
    per_date = panel.groupBy("panel_id", "t_idx").agg(
        F.array(*(F.struct(F.lit(x).alias("threshold"), here(x).alias("n")) for x in thresholds)).alias("all")
    )
    return per_date.select("panel_id", "t_idx", F.explode("all").alias("x")).select("panel_id", "x.threshold", "t_idx", "x.n")


def count_summary(counts: DataFrame) -> DataFrame:
    """How many names were selected, over the dates with any; least and most are 0 where there are none."""
    some = F.when(F.col("n") > 0, F.col("n"))
    quartiles = F.percentile(some, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        counts.groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("n_dates"), F.count(some).alias("n_dates_selected"), F.sum("n").alias("n_predictions"),
            F.avg(some).alias("avg_names"), F.coalesce(F.min(some), F.lit(0)).alias("min_names"), quartiles.alias("q"), F.coalesce(F.max(some), F.lit(0)).alias("max_names"),
        )
        .select(*KEYS, "n_dates", "n_dates_selected", "n_predictions", "avg_names", "min_names",
                F.col("q")[0].alias("p25_names"), F.col("q")[1].alias("median_names"), F.col("q")[2].alias("p75_names"), "max_names")
    )


def nested_weights(panel: DataFrame, thresholds: tuple[float, ...], exposure: str = "as_selected") -> DataFrame:
    """``weights`` of every (date, entity), one for each threshold: sides over the number held, or half of each side.

    The thresholds stand side by side in an array, so the panel is shuffled once whatever their number."""
    by_date = Window.partitionBy("panel_id", "t_idx")
    n = lambda where: F.count_if(where).over(by_date)

    def own(threshold: float) -> Column:
        held = selected(threshold)
        if exposure == "as_selected":
            return F.when(held, sign(F.col("pred")) / n(held))
        if exposure == "dollar_neutral":
            long, short = held & (F.col("pred") > 0), held & (F.col("pred") < 0)
            both = (n(long) > 0) & (n(short) > 0)
            return F.when(both & long, 0.5 / n(long)).when(both & short, -0.5 / n(short))
        raise ValueError(f"unknown exposure {exposure}")

    weights = F.array(*(F.coalesce(own(x), F.lit(0.0)) for x in thresholds))
    return panel.select("panel_id", "t_idx", "date", "e_idx", "entity", weights.alias("weights"))


def target_weights(panel: DataFrame, thresholds: tuple[float, ...], exposure: str = "as_selected") -> DataFrame:
    """threshold and weight of every (date, entity)."""
    every = F.array(*(F.struct(F.lit(x).alias("threshold"), F.col("weights")[i].alias("weight")) for i, x in enumerate(thresholds)))
    rows = nested_weights(panel, thresholds, exposure).withColumn("x", F.explode(every))
    return rows.select("panel_id", "x.threshold", "t_idx", "date", "e_idx", "entity", "x.weight")


def by_threshold(rows: DataFrame, keys: tuple[str, ...], thresholds: tuple[float, ...], figures) -> DataFrame:
    """keys, threshold and ``figures`` (a function of a threshold and its place, that gives named aggregates), in one pass for all."""
    every = F.array(*(F.struct(F.lit(x).alias("threshold"), *figures(x, i)) for i, x in enumerate(thresholds)))
    return rows.groupBy(*keys).agg(every.alias("all")).select(*keys, F.explode("all").alias("x")).select(*keys, "x.*")
