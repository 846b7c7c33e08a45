"""Estimators on SERIES: autocorrelation, HAC inference, block lengths, rolling Sharpe.

Lags are equi-joins of a series with itself on (keys, u), so long series and many of
them spread over tasks, and no series is ever gathered in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.special import normal_cdf, normal_quantile
from panelspark.operators.aggregate import KEYS, sharpe_of


def lagged(rows: DataFrame, keys: tuple[str, ...], upto: Column, values: tuple[str, ...]) -> DataFrame:
    """Each row with the row ``k`` later (columns prefixed later_), for k = 0 .. upto."""
    early = rows.withColumn("k", F.explode(F.sequence(F.lit(0), upto.cast("int")))).withColumn("at", F.col("u") + F.col("k"))
    late = rows.select(*keys, F.col("u").alias("at"), *(F.col(v).alias(f"later_{v}") for v in values))
    return early.join(late, [*keys, "at"])


def moments(series: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, mean and second moment (both over n) of each series."""
    return series.groupBy(*keys).agg(F.count("r").alias("n"), F.avg("r").alias("mu"), F.avg(F.col("r") * F.col("r")).alias("m2"))


def with_moments(series: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The series with n, mu and m2 (see :func:`moments`) in every row: a window instead of a join with itself."""
    own = Window.partitionBy(*keys)
    r = F.col("r")
    return series.withColumn("n", F.count(r).over(own)).withColumn("mu", F.avg(r).over(own)).withColumn("m2", F.avg(r * r).over(own))


def autocorrelation(series: DataFrame, max_lag: int = 20, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """k and rho for k = 0 .. min(max_lag, n - 1); 0 beyond lag 0 for a series without spread."""
    rows = with_moments(series, keys).withColumn("x", F.col("r") - F.col("mu"))
    products = lagged(rows, keys, F.least(F.lit(max_lag), F.col("n") - 1), ("x",))
    sums = products.groupBy(*keys, "k").agg(F.sum(F.col("x") * F.col("later_x")).alias("c"), F.first("n").alias("n"))
    c0 = F.max(F.when(F.col("k") == 0, F.col("c"))).over(Window.partitionBy(*keys))
    rho = F.when(F.col("k") == 0, 1.0).when(c0 > 0, F.col("c") / c0).otherwise(0.0)
    return sums.select(*keys, "k", rho.alias("rho"), "n")


def effective_size(series: DataFrame, max_lag: int = 50, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n and n_eff = n / (1 + 2 sum of the autocorrelations before the first negative one)."""
    rho = autocorrelation(series, max_lag, keys).filter(F.col("k") <= F.greatest(F.lit(1), F.expr("n div 3")))
    so_far = F.min("rho").over(Window.partitionBy(*keys).orderBy("k"))
    kept = rho.withColumn("lowest", so_far).withColumn("kept", F.when((F.col("k") > 0) & (F.col("lowest") >= 0), F.col("rho")).otherwise(0.0))
    size = F.greatest(F.lit(1.0), F.col("n") / (1 + 2 * F.col("tau")))
    return kept.groupBy(*keys).agg(F.first("n").alias("n"), F.sum("kept").alias("tau")).select(*keys, "n", size.alias("n_eff"))


def bandwidths(series: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The automatic Bartlett bandwidth under a first-order autoregression; 0 below three values."""
    rows = with_moments(series, keys).withColumn("x", F.col("r") - F.col("mu"))
    previous = rows.withColumn("before", F.lag("x").over(Window.partitionBy(*keys).orderBy("u")))
    fit = previous.groupBy(*keys).agg(
        F.first("n").alias("n"), F.sum(F.col("before") * F.col("x")).alias("s01"), F.sum(F.col("before") * F.col("before")).alias("s00")
    )
    rho = F.greatest(F.lit(-0.95), F.least(F.lit(0.95), F.when(F.col("s00") > 0, F.col("s01") / F.col("s00")).otherwise(0.0)))
    fit = fit.withColumn("rho", rho)
    alpha = 4 * F.col("rho") * F.col("rho") / F.greatest(F.pow(1 - F.col("rho"), F.lit(4.0)), F.lit(1e-8))
    width = F.ceil(1.1447 * F.pow(F.greatest(alpha * F.col("n"), F.lit(1.0)), F.lit(1.0 / 3.0)))
    chosen = F.greatest(F.lit(1), F.least(width, F.greatest(F.lit(1), F.col("n") - 1)))
    return fit.select(*keys, F.when(F.col("n") < 3, 0).otherwise(chosen).cast("int").alias("bandwidth"))


def long_run_covariance(series: DataFrame, widths: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, mu, m2 and the Bartlett-weighted covariance (s11, s12, s22) of (r, r squared).

    ``widths`` has a ``bandwidth`` for the keys; it may have more keys than the series."""
    wide = tuple(c for c in widths.columns if c != "bandwidth")
    rows = with_moments(series, keys).join(widths, list(keys))
    rows = rows.withColumn("x", F.col("r") - F.col("mu")).withColumn("y", F.col("r") * F.col("r") - F.col("m2"))
    rows = rows.withColumn("bandwidth", F.least("bandwidth", F.col("n") - 1))
    products = lagged(rows, wide, F.col("bandwidth"), ("x", "y"))
    w = F.when(F.col("k") == 0, 0.5).otherwise(1 - F.col("k") / (F.col("bandwidth") + 1.0))
    both = lambda a, b: F.sum(w * (F.col(a) * F.col(f"later_{b}") + F.col(b) * F.col(f"later_{a}"))) / F.first("n")
    return products.groupBy(*wide).agg(
        F.first("n").alias("n"), F.first("mu").alias("mu"), F.first("m2").alias("m2"), F.first("bandwidth").alias("bandwidth"),
        both("x", "x").alias("s11"), both("x", "y").alias("s12"), both("y", "y").alias("s22"),
    )


def delta_method(covariance: DataFrame, annualise: float, confidence: float = 0.95, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Sharpe ratio with its delta-method error, interval and p-values from a long-run covariance.

    Series of fewer than five values have a null error."""
    n, mu, m2 = F.col("n"), F.col("mu"), F.col("m2")
    root = annualise**0.5
    rows = covariance.withColumn("v", F.greatest(m2 - mu * mu, F.lit(1e-16)))
    rows = rows.withColumn("sharpe", root * mu / F.sqrt("v"))
    g1, g2 = root * m2 / F.pow("v", F.lit(1.5)), -0.5 * root * mu / F.pow("v", F.lit(1.5))
    spread = (g1 * g1 * F.col("s11") + 2 * g1 * g2 * F.col("s12") + g2 * g2 * F.col("s22")) / n
    rows = rows.withColumn("se", F.when(n >= 5, F.sqrt(F.greatest(spread, F.lit(0.0)))))
    rows = rows.withColumn("z_statistic", F.when(F.col("se") > 0, F.col("sharpe") / F.col("se")).when(F.col("se") == 0, float("inf")))
    rows = rows.withColumn("positive_p_value", 1 - normal_cdf(F.col("z_statistic")))
    half = normal_quantile(0.5 + confidence / 2)
    return rows.select(
        *keys, "n", "sharpe", "se", (F.col("sharpe") - half * F.col("se")).alias("ci_lo"), (F.col("sharpe") + half * F.col("se")).alias("ci_hi"),
        "z_statistic", "positive_p_value",
        (2 * F.least(F.col("positive_p_value"), 1 - F.col("positive_p_value"))).alias("two_sided_p_value"),
        mu.alias("mean_return"), F.sqrt(F.greatest("s11", F.lit(0.0)) / n).alias("mean_return_se"), "bandwidth",
    )


def hac_sharpe(series: DataFrame, annualise: float, lag: int | None = None, confidence: float = 0.95, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """HAC delta-method inference, with a fixed lag or the automatic one."""
    widths = bandwidths(series, keys) if lag is None else series.select(*keys).distinct().withColumn("bandwidth", F.lit(lag))
    return delta_method(long_run_covariance(series, widths, keys), annualise, confidence, keys)


def bandwidth_sweep(series: DataFrame, annualise: float, lags: tuple[int, ...] = (0, 1, 5, 10, 21, 63, 126), keys: tuple[str, ...] = KEYS) -> DataFrame:
    """HAC inference at the automatic and at given lags (label, requested and used)."""
    auto = bandwidths(series, keys).withColumn("lag_label", F.lit("auto")).withColumn("requested_lag", F.lit(None).cast("int"))
    given = F.explode(F.array(*map(F.lit, lags)))
    fixed = series.select(*keys).distinct().withColumn("requested_lag", given).withColumn("lag_label", F.col("requested_lag").cast("string"))
    widths = auto.unionByName(fixed.withColumn("bandwidth", F.col("requested_lag"))).select(*keys, "lag_label", "requested_lag", "bandwidth")
    named = (*keys, "lag_label")
    found = delta_method(long_run_covariance(series, widths.drop("requested_lag"), keys), annualise, keys=named)
    return found.join(widths.select(*named, "requested_lag"), list(named)).select(
        *named, "requested_lag", F.col("bandwidth").alias("used_bandwidth"), "sharpe", "se", "ci_lo", "ci_hi", "positive_p_value"
    )


def sharpe_effective_size(series: DataFrame, annualise: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n_eff_sr: n scaled by the ratio of the iid to the HAC variance, within 1 and n."""
    iid = hac_sharpe(series, annualise, 0, keys=keys).select(*keys, "n", F.col("se").alias("se_iid_delta"))
    hac = hac_sharpe(series, annualise, keys=keys).select(*keys, F.col("se").alias("se_hac_delta"), F.col("bandwidth").alias("hac_bandwidth"))
    both = iid.join(hac, list(keys)).withColumn("se_inflation", F.try_divide("se_hac_delta", "se_iid_delta"))
    scaled = F.col("n") * F.pow(F.try_divide("se_iid_delta", "se_hac_delta"), F.lit(2.0))
    size = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.coalesce(scaled, F.col("n").cast("double"))))
    return both.select(*keys, size.alias("n_eff_sr"), "se_iid_delta", "se_hac_delta", "se_inflation", "hac_bandwidth")


def block_lengths(series: DataFrame, exponent: float = 0.2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rule-of-thumb block length: n ** exponent, longer for positive first autocorrelation."""
    first = autocorrelation(series, 1, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.max(F.when(F.col("k") == 1, F.col("rho"))).alias("rho"))
    rho = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.coalesce("rho", F.lit(0.0))))
    factor = F.when(rho > 0, F.pow(2 * rho / (1 - rho), F.lit(2.0 / 3.0))).otherwise(1.0)
    length = F.ceil(F.pow(F.col("n").cast("double"), F.lit(exponent)) * F.greatest(factor, F.lit(1.0)))
    chosen = F.greatest(F.lit(1), F.least(length, F.greatest(F.lit(1), F.expr("n div 3"))))
    return first.select(*keys, "n", F.when(F.col("n") < 10, F.greatest(F.lit(1), "n")).otherwise(chosen).cast("int").alias("block_size"))


def rolling_sharpe(series: DataFrame, annualise: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Lowest and highest Sharpe ratio (0 without spread) of all full windows of min(252, max(30, n div 5)) values."""
    n = F.count("r").over(Window.partitionBy(*keys))
    rows = series.withColumn("rolling_window", F.least(F.lit(252), F.greatest(F.lit(30), F.floor(n / 5))).cast("int"))
    # prefix sums of the centred values: a window of any width is a difference of two of them
    centre = F.avg("r").over(Window.partitionBy(*keys))
    rows = rows.withColumn("x", F.col("r") - centre).withColumn("centre", centre)
    upto = Window.partitionBy(*keys).orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("s1", F.sum("x").over(upto)).withColumn("s2", F.sum(F.col("x") * F.col("x")).over(upto))
    start = sums.select(*keys, (F.col("u") + F.col("rolling_window")).alias("u"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    whole = sums.join(start, [*keys, "u"], "left").filter(F.col("u") >= F.col("rolling_window") - 1)
    w = F.col("rolling_window")
    t1, t2 = F.col("s1") - F.coalesce("b1", F.lit(0.0)), F.col("s2") - F.coalesce("b2", F.lit(0.0))
    spread = F.sqrt(F.greatest((t2 - t1 * t1 / w) / (w - 1), F.lit(0.0)))
    value = F.when(spread > 0, (t1 / w + F.col("centre")) / spread * annualise**0.5).otherwise(0.0)
    return whole.groupBy(*keys, "rolling_window").agg(F.min(value).alias("rolling_sr_min"), F.max(value).alias("rolling_sr_max"))


def date_sharpe(series: DataFrame, annualise: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n and the plain Sharpe ratio of each series."""
    return series.groupBy(*keys).agg(F.count("r").alias("n"), sharpe_of(F.col("r"), annualise).alias("sharpe"))
