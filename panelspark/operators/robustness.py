"""Robustness of the HAC inference: prewhitening, and how dependence inflates uncertainty.

A series' vector autoregression has two equations, so its fit, its spectral radius and the
recolouring are closed forms over sums: nothing but grouped sums and a window over a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.special import normal_cdf
from panelspark.operators.aggregate import KEYS
from panelspark.operators.series import bandwidths, delta_method, hac_sharpe, lagged, long_run_covariance, moments, rolling_sharpe, with_moments
from panelspark.tables import spread

#: The autoregression is scaled down to this spectral radius.
LARGEST_RADIUS = 0.98
SHORTEST = 8


def autoregression(lagged: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """p11, p12, p21 and p22 of the least-squares fit of (x, y) on (before_x, before_y).

    Where the two regressors are collinear, the fit of least norm."""
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = lagged.filter("before_x IS NOT NULL").groupBy(*keys).agg(
        product("before_x", "before_x").alias("a"), product("before_x", "before_y").alias("b"), product("before_y", "before_y").alias("d"),
        product("x", "before_x").alias("xx"), product("x", "before_y").alias("xy"), product("y", "before_x").alias("yx"), product("y", "before_y").alias("yy"),
    )
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    det, trace = a * d - b * b, a + d
    whole = det > 1e-13 * a * d
    inverse = lambda full, single: F.when(whole, full / det).when(trace > 0, single / (trace * trace)).otherwise(0.0)
    sums = sums.withColumn("i11", inverse(d, a)).withColumn("i12", inverse(-b, b)).withColumn("i22", inverse(a, d))
    of = lambda s, t, i, j: F.col(s) * F.col(i) + F.col(t) * F.col(j)
    fit = sums.select(
        *keys, of("xx", "xy", "i11", "i12").alias("p11"), of("xx", "xy", "i12", "i22").alias("p12"),
        of("yx", "yy", "i11", "i12").alias("p21"), of("yx", "yy", "i12", "i22").alias("p22"),
    )
    half, det = (F.col("p11") + F.col("p22")) / 2, F.col("p11") * F.col("p22") - F.col("p12") * F.col("p21")
    inside = half * half - det
    radius = F.when(inside >= 0, F.abs(half) + F.sqrt(F.greatest(inside, F.lit(0.0)))).otherwise(F.sqrt(F.abs(det)))
    shrunk = F.when(radius >= LARGEST_RADIUS, LARGEST_RADIUS / radius).otherwise(1.0)
    fit = fit.withColumn("shrunk", shrunk)
    return fit.select(*keys, *((F.col(p) * F.col("shrunk")).alias(p) for p in ("p11", "p12", "p21", "p22")))


def prewhitened_covariance(series: DataFrame, lag: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, mu, m2, bandwidth and the recoloured long-run covariance (s11, s12, s22) of (r, r squared).

    Series of fewer than ``SHORTEST`` values have no row."""
    rows = with_moments(series, keys).filter(F.col("n") >= SHORTEST)
    rows = rows.withColumn("x", F.col("r") - F.col("mu")).withColumn("y", F.col("r") * F.col("r") - F.col("m2"))
    order = Window.partitionBy(*keys).orderBy("u")
    rows = rows.withColumn("before_x", F.lag("x").over(order)).withColumn("before_y", F.lag("y").over(order))
    fit = autoregression(rows, keys)
    left = lambda now, p, q: F.col(now) - F.col(p) * F.col("before_x") - F.col(q) * F.col("before_y")
    residuals = rows.filter("before_x IS NOT NULL").join(fit, list(keys)).select(
        *keys, F.col("u").cast("int").alias("u"), left("x", "p11", "p12").alias("r"), left("y", "p21", "p22").alias("q")
    )
    widths = bandwidths(residuals, keys) if lag is None else residuals.select(*keys).distinct().withColumn("bandwidth", F.lit(lag))
    means = residuals.groupBy(*keys).agg(F.count("r").alias("m"), F.avg("r").alias("mean_r"), F.avg("q").alias("mean_q"))
    centred = residuals.join(means, list(keys)).join(widths, list(keys))
    centred = centred.withColumn("e", F.col("r") - F.col("mean_r")).withColumn("f", F.col("q") - F.col("mean_q"))
    centred = centred.withColumn("bandwidth", F.least("bandwidth", F.col("m") - 1).cast("int"))
    products = lagged(centred, keys, F.col("bandwidth"), ("e", "f"))
    w = F.when(F.col("k") == 0, 0.5).otherwise(1 - F.col("k") / (F.col("bandwidth") + 1.0))
    both = lambda a, b: F.sum(w * (F.col(a) * F.col(f"later_{b}") + F.col(b) * F.col(f"later_{a}"))) / F.first("m")
    white = products.groupBy(*keys).agg(F.first("bandwidth").alias("bandwidth"), both("e", "e").alias("w11"), both("e", "f").alias("w12"), both("f", "f").alias("w22"))
    found = white.join(fit, list(keys)).join(moments(series, keys), list(keys))
    det = (1 - F.col("p11")) * (1 - F.col("p22")) - F.col("p12") * F.col("p21")
    found = found.withColumn("a11", (1 - F.col("p22")) / det).withColumn("a12", F.col("p12") / det)
    found = found.withColumn("a21", F.col("p21") / det).withColumn("a22", (1 - F.col("p11")) / det)
    return found.select(*keys, "n", "mu", "m2", "bandwidth", _recoloured(1, 1).alias("s11"), _recoloured(1, 2).alias("s12"), _recoloured(2, 2).alias("s22"))


def _recoloured(i: int, j: int) -> Column:
    """A cell of a w a'."""
    a = lambda row, column: F.col(f"a{row}{column}")
    cross = a(i, 1) * a(j, 2) + a(i, 2) * a(j, 1)
    return a(i, 1) * a(j, 1) * F.col("w11") + cross * F.col("w12") + a(i, 2) * a(j, 2) * F.col("w22")


def prewhitened_hac(series: DataFrame, annualise: float, lag: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Delta-method inference from the prewhitened and recoloured covariance."""
    return delta_method(prewhitened_covariance(series, lag, keys), annualise, keys=keys)


def inflation(factors: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The variance inflation (uvif) and information ratio (erir) of standard error inflations
    (``sei``), as they are and with the inflation not below 1."""
    uvif = F.col("sei") * F.col("sei")
    shown = F.greatest(F.lit(1.0), uvif)
    return factors.select(
        *keys, "sei", uvif.alias("uvif_unclipped"), F.when(uvif.isNotNull(), shown).alias("uvif_displayed"),
        F.when(uvif > 0, 1 / uvif).alias("erir_unclipped"), F.when(uvif.isNotNull(), 1 / shown).alias("erir_displayed"),
    )


def sharpe_inflation(dates: DataFrame, rows: DataFrame, annualise: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """uvif_sr: the HAC variance of the date series' Sharpe ratio (``dates``) over the variance
    that the pooled rows (``rows``, likewise keys, u and r) would give if they were independent."""
    date = hac_sharpe(dates, annualise, keys=keys).select(*keys, F.col("se").alias("se_dates"))
    row = hac_sharpe(rows, annualise, 0, keys=keys).select(*keys, F.col("se").alias("se_rows"))
    ratio = F.try_divide("se_dates", "se_rows")
    return date.join(row, list(keys)).select(*keys, "se_dates", "se_rows", (ratio * ratio).alias("uvif_sr"))


def _hac_z(draws: np.ndarray, width: int, annualise: float) -> np.ndarray:
    """The delta-method z statistic of each row, at a fixed bandwidth."""
    n = draws.shape[1]
    mu, m2 = draws.mean(axis=1), (draws * draws).mean(axis=1)
    x, y = draws - mu[:, None], draws * draws - m2[:, None]
    s11, s12, s22 = (x * x).mean(axis=1), (x * y).mean(axis=1), (y * y).mean(axis=1)
    for k in range(1, width + 1):
        w = 1 - k / (width + 1)
        early_x, late_x, early_y, late_y = x[:, :-k], x[:, k:], y[:, :-k], y[:, k:]
        s11 += w * 2 * (early_x * late_x).sum(axis=1) / n
        s12 += w * ((early_x * late_y).sum(axis=1) + (early_y * late_x).sum(axis=1)) / n
        s22 += w * 2 * (early_y * late_y).sum(axis=1) / n
    v = np.maximum(m2 - mu * mu, 1e-16)
    root = math.sqrt(annualise)
    g1, g2 = root * m2 / v**1.5, -0.5 * root * mu / v**1.5
    error = np.sqrt(np.maximum((g1 * g1 * s11 + 2 * g1 * g2 * s12 + g2 * g2 * s22) / n, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(error > 0, root * mu / np.sqrt(v) / error, np.inf)


def fixed_b(
    series: DataFrame, annualise: float, shares: tuple[float, ...] = (0.02, 0.05, 0.10, 0.20), sims: int = 499, longest: int = 1000, seed: int = 42,
    block: int = 100, keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """HAC inference at bandwidths of given shares of the length, with p-values and critical values from
    normal series without a mean at the same share (max(50, min(longest, n)) values long).

    Series of fewer than twenty values have no row. A task has a block of simulated series."""
    lengths = series.groupBy(*keys).agg(F.count("r").alias("n")).filter("n >= 20").withColumn("b", F.explode(F.array(*map(F.lit, shares))))
    width = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(F.col("b") * F.col("n")))).cast("int")
    sim_n = F.greatest(F.lit(50), F.least(F.lit(longest), F.col("n"))).cast("int")
    lengths = lengths.withColumn("bandwidth", width).withColumn("simulation_length", sim_n)
    lengths = lengths.withColumn("simulation_bandwidth", F.greatest(F.lit(0), F.least(F.col("simulation_length") - 1, F.bround(F.col("b") * F.col("simulation_length")))).cast("int"))
    named = (*keys, "b")
    observed = delta_method(long_run_covariance(series, lengths.select(*named, "bandwidth"), keys), annualise, keys=named)
    observed = observed.select(*named, "sharpe", "se", "z_statistic", F.col("positive_p_value").alias("normal_positive_p"))
    work = lengths.select(*named, "simulation_length", "simulation_bandwidth").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(sims - 1), F.lit(block))))
    types = dict(series.dtypes)

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                rng = np.random.default_rng([seed, int(round(row["b"] * 10_000)), row["first"]])
                draws = rng.normal(0.0, 1.0, (min(block, sims - row["first"]), row["simulation_length"]))
                yield pd.DataFrame({**{k: row[k] for k in named}, "z": _hac_z(draws, row["simulation_bandwidth"], annualise)})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", b double, z double"
    null = spread(work, *named, "first").mapInPandas(simulate, schema).filter(~F.isnan("z") & (F.abs("z") < float("inf")))
    rows = null.join(observed, list(named)).groupBy(*named).agg(
        F.count_if(F.col("z") >= F.col("z_statistic")).alias("above"), F.count_if(F.abs("z") >= F.abs("z_statistic")).alias("beyond"), F.count(F.lit(1)).alias("n_sim"),
        F.percentile("z", 0.95).alias("fixedb_crit_95"), F.percentile(F.abs("z"), 0.95).alias("fixedb_abs_crit_95"),
    )
    smooth = lambda c: (1 + F.col(c)) / (1 + F.col("n_sim"))
    return lengths.join(observed, list(named)).join(rows, list(named)).select(
        *named, "bandwidth", "simulation_length", "simulation_bandwidth", "sharpe", "se", "z_statistic", "normal_positive_p",
        smooth("above").alias("fixedb_positive_p"), smooth("beyond").alias("fixedb_two_sided_p"), "fixedb_crit_95", "fixedb_abs_crit_95", "n_sim",
    )


#: Response surfaces of the unit-root test with a constant (bounds, switch, and the polynomials
#: of the statistic, lowest power first), and critical values of the stationarity test with their odds.
ROOT_LEAST, ROOT_MOST, ROOT_SWITCH = -18.83, 2.74, -1.61
ROOT_SMALL = (2.1659, 1.4412, 0.038269)
ROOT_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
LEVEL_CRITICAL, LEVEL_ODDS = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def unit_root_t(r: np.ndarray) -> float:
    """The augmented unit-root test's statistic: a constant, and as many lagged differences as the least AIC takes.

    One matrix of products of the level, a constant, all lagged differences and the step serves all choices: its
    triangular factor, column by column, holds what each more lag leaves unexplained. The chosen one adds the
    products of the dates that it gains."""
    n = len(r)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    step = np.diff(r)

    def columns(lags: int, start: int, end: int) -> np.ndarray:
        """Constant, level, the lagged differences and the step, a row for each date."""
        return np.column_stack([np.ones(end - start), r[start:end], *(step[start - k : end - k] for k in range(1, lags + 1)), step[start:end]])

    rows = columns(most, most, n - 1)
    products = rows.T @ rows
    left = np.linalg.cholesky(products)[-1] ** 2  # of the step, by each column, and what all leave
    rss = np.cumsum(left[::-1])[::-1][2:]  # after the constant, the level and 0, 1 .. lags
    lags = int(np.argmin(len(rows) * (np.log(2 * math.pi * rss / len(rows)) + 1) + 2 * np.arange(2, most + 3)))
    chosen, gained = [0, *range(2, 2 + lags), 1, most + 2], columns(lags, lags, most)
    gained = gained[:, [0, *range(2, 2 + lags), 1, lags + 2]]
    factor = np.linalg.cholesky(products[np.ix_(chosen, chosen)] + gained.T @ gained)
    return float(factor[-1, -2] / math.sqrt(factor[-1, -1] ** 2 / (n - 1 - lags - (lags + 2))))


def unit_root_p(t: Column) -> Column:
    """The p-value of the unit-root statistic."""
    power = lambda powers: sum((c * F.pow(t, F.lit(float(i))) for i, c in enumerate(powers[1:], 1)), F.lit(powers[0]))
    inside = normal_cdf(F.when(t <= ROOT_SWITCH, power(ROOT_SMALL)).otherwise(power(ROOT_LARGE)))
    return F.when(t > ROOT_MOST, 1.0).when(t < ROOT_LEAST, 0.0).when(t.isNotNull(), inside)


def level_statistic(r: np.ndarray) -> float:
    """The stationarity test's statistic about a constant, with a data-driven Bartlett window."""
    n = len(r)
    x = r - r.mean()
    s0, s1 = float(x @ x) / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        product = float(x[k:] @ x[:-k]) / (n / 2)
        s0, s1 = s0 + product, s1 + k * product
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = float(x @ x) + 2 * sum((1 - k / (lags + 1)) * float(x[k:] @ x[:-k]) for k in range(1, lags + 1))
    return float((np.cumsum(x) ** 2).sum()) / n**2 / (long_run / n)


def level_p(statistic: Column) -> Column:
    """The p-value of the stationarity statistic: between the critical values, 0.01 to 0.1."""
    out = F.when(statistic <= LEVEL_CRITICAL[0], LEVEL_ODDS[0])
    for (low, high), (a, b) in zip(pairwise(LEVEL_CRITICAL), pairwise(LEVEL_ODDS), strict=True):
        out = out.when(statistic <= high, a + (b - a) * (statistic - low) / (high - low))
    return out.when(statistic.isNotNull(), LEVEL_ODDS[-1])


def stationarity(series: DataFrame, annualise: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, adf_p, kpss_p and the extremes of the rolling Sharpe ratio; null below 30 values, and each p-value
    where its test fails. A series is one value a date, a bounded array."""
    types = dict(series.dtypes)

    def tests(group: pd.DataFrame) -> pd.DataFrame:
        r = group.sort_values("u")["r"].to_numpy()
        out = []
        for test in (unit_root_t, level_statistic):
            try:
                with np.errstate(all="raise"):
                    out.append(test(r) if len(r) >= 30 else None)
            except (ValueError, ArithmeticError, np.linalg.LinAlgError):
                out.append(None)
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), len(r), *out]], columns=[*keys, "n", "root_t", "level"])

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", n long, root_t double, level double"
    rolling = rolling_sharpe(series, annualise, keys).drop("rolling_window")
    found = series.groupBy(*keys).applyInPandas(tests, schema).join(rolling, list(keys), "left")
    found = found.select(*keys, "n", unit_root_p(F.col("root_t")).alias("adf_p"), level_p(F.col("level")).alias("kpss_p"), "rolling_sr_min", "rolling_sr_max")
    return found.withColumns({c: F.when(F.col("n") >= 30, F.col(c)) for c in ("rolling_sr_min", "rolling_sr_max")})
