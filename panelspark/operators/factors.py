"""What factors leave of a strategy's return: regression with a HAC error, and the panel against a direct portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.special import normal_cdf
from panelspark.operators.aggregate import KEYS, sharpe_of
from panelspark.operators.portfolio import day
from panelspark.operators.series import bandwidths, lagged
from panelspark.tables import written

REGRESSORS = ("mkt_rf", "smb", "hml", "mom")


def aligned(dates: DataFrame, factors: DataFrame) -> DataFrame:
    """keys, date, ret and the regressors, on the dates that have all of them."""
    return dates.select(*KEYS, "date", "ret").join(factors.select("date", *REGRESSORS), "date").dropna().select(*KEYS, "date", "ret", *REGRESSORS)


def normal_equations(rows: DataFrame) -> DataFrame:
    """m_i_j for the sums of products of a constant (0), the regressors and, as the last column, ret; n of each series."""
    x = (F.lit(1.0), *map(F.col, REGRESSORS), F.col("ret"))
    last = len(REGRESSORS) + 1
    sums = [F.sum(x[i] * x[j]).alias(f"m_{i}_{j}") for i in range(last) for j in range(last + 1)]
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *sums)


def solved(sums: DataFrame) -> DataFrame:
    """b_i and a_i of each series: the coefficients, and the first row of the inverse of the products' matrix.

    Elimination, a regressor a step, as expressions; one that the others before it explain, but for a share of
    1e-12, has no part: both its numbers are 0."""
    last = len(REGRESSORS) + 1
    columns = range(last + 2)
    now = sums.withColumns({f"m_{i}_{last + 1}": F.lit(1.0 if i == 0 else 0.0) for i in range(last)} | {f"d_{i}": F.col(f"m_{i}_{i}") for i in range(last)})
    for k in range(last):
        pivot = F.when(F.col(f"m_{k}_{k}") > 1e-12 * F.col(f"d_{k}"), 1 / F.col(f"m_{k}_{k}")).otherwise(0.0)
        now = now.withColumn("f", pivot)
        now = now.withColumns({f"m_{i}_{j}": F.col(f"m_{i}_{j}") - F.col(f"m_{i}_{k}") * F.col("f") * F.col(f"m_{k}_{j}") for i in range(last) if i != k for j in columns if j > k})
        now = now.withColumns({f"m_{k}_{j}": F.col(f"m_{k}_{j}") * F.col("f") for j in columns if j > k})
    return now.select(*KEYS, "n", *(F.col(f"m_{i}_{last}").alias(f"b_{i}") for i in range(last)), *(F.col(f"m_{i}_{last + 1}").alias(f"a_{i}") for i in range(last)))


def factor_alpha(dates: DataFrame, factors: DataFrame, annualise: float, least: int = 30) -> DataFrame:
    """n, alpha_period, alpha_ann, alpha_se_period, t_alpha, p_positive, hac_lag and status of each series: least squares
    on a constant and the factors, with Bartlett weights up to the automatic bandwidth of the returns.

    All of it are grouped sums: of products for the coefficients, and of the lagged products of one number a date, the
    score seen through the inverse's first row, for the error. Below ``least`` common dates p_positive is 1 and the
    rest null."""
    rows = aligned(dates, factors).withColumn("u", F.row_number().over(Window.partitionBy(*KEYS).orderBy("date")) - 1)
    rows = written(rows, "aligned")
    widths = bandwidths(rows.select(*KEYS, "u", F.col("ret").alias("r")))
    found = written(solved(normal_equations(rows)).join(widths, list(KEYS)), "regressions")
    x = (F.lit(1.0), *map(F.col, REGRESSORS))
    through = lambda c: sum((x[i] * F.col(f"{c}_{i}") for i in range(1, len(x))), F.col(f"{c}_0"))
    scores = rows.join(found, list(KEYS)).select(*KEYS, "u", F.least("bandwidth", F.col("n") - 1).alias("lag"), "bandwidth", (through("a") * (F.col("ret") - through("b"))).alias("g"))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("bandwidth") + 1.0)))
    spread = lagged(scores, KEYS, F.col("lag"), ("g",)).groupBy(*KEYS).agg(F.sum(weight * F.col("g") * F.col("later_g")).alias("v"))
    every = dates.select(*KEYS).distinct().join(found, list(KEYS), "left").join(spread, list(KEYS), "left")
    enough = F.col("n") >= least
    every = every.withColumn("alpha", F.when(enough, F.col("b_0"))).withColumn("se", F.when(enough, F.sqrt(F.greatest("v", F.lit(0.0)))))
    every = every.withColumn("t_alpha", F.when(F.col("se") > 0, F.col("alpha") / F.col("se")).when(F.col("se") == 0, float("inf")))
    return every.select(
        *KEYS, F.coalesce("n", F.lit(0)).alias("n"), F.col("alpha").alias("alpha_period"), (F.col("alpha") * annualise).alias("alpha_ann"), F.col("se").alias("alpha_se_period"),
        "t_alpha", F.coalesce(1 - normal_cdf(F.col("t_alpha")), F.lit(1.0)).alias("p_positive"), F.when(enough, F.col("bandwidth")).alias("hac_lag"), F.lit("ok").alias("status"),
    )


def direct_benchmark(dates: DataFrame, returns: DataFrame, annualise: float) -> DataFrame:
    """Date returns against the last entity's return less the first one's on the following date: n, the
    common dates, both Sharpe ratios and means, and the median of their ratio."""
    place = returns.groupBy("panel_id").agg(F.max("e_idx").alias("last"))
    ends = returns.join(F.broadcast(place), "panel_id").filter("e_idx = 0 or e_idx = last").groupBy("panel_id", "t_idx", "date").agg(
        (F.max(F.when(F.col("e_idx") == F.col("last"), F.col("ret"))) - F.max(F.when(F.col("e_idx") == 0, F.col("ret")))).alias("direct")
    )
    ends = ends.filter("direct is not null").select("panel_id", (F.col("t_idx") - 1).alias("t_idx"), F.col("date").alias("direct_date"), "direct")
    both = dates.filter("ret is not null").join(ends, ["panel_id", "t_idx"])
    scale = F.when(F.abs("direct") > 1e-12, F.col("ret") / F.col("direct"))
    found = both.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), day(F.min("direct_date")).alias("sample_start"), day(F.max("direct_date")).alias("sample_end"),
        sharpe_of(F.col("ret"), annualise).alias("panel_sharpe"), sharpe_of(F.col("direct"), annualise).alias("direct_sharpe"),
        F.avg("ret").alias("panel_mean"), F.avg("direct").alias("direct_mean"), F.median(scale).alias("median_scale"),
    )
    return found.withColumn("sharpe_abs_diff", F.abs(F.col("panel_sharpe") - F.col("direct_sharpe")))
