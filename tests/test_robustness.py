"""Prewhitened inference and inflation factors against plain numpy."""

import math

import numpy as np
import pytest

from panelspark.operators import robustness

SCHEMA = "panel_id string, threshold double, u int, r double"


def frame(spark, values):
    return spark.createDataFrame([("p", 0.5, i, float(v)) for i, v in enumerate(values)], SCHEMA)


def plain_error(r, lag, annualise):
    """The standard error by matrices, for a given bandwidth."""
    r = np.asarray(r)
    z = np.column_stack([r, r * r])
    z = z - z.mean(axis=0)
    phi = np.linalg.lstsq(z[:-1], z[1:], rcond=None)[0].T
    radius = max(abs(np.linalg.eigvals(phi)))
    phi = phi * (0.98 / radius if radius >= 0.98 else 1.0)
    e = z[1:] - z[:-1] @ phi.T
    e = e - e.mean(axis=0)
    omega = e.T @ e / len(e)
    for k in range(1, lag + 1):
        g = e[k:].T @ e[:-k] / len(e)
        omega = omega + (1 - k / (lag + 1)) * (g + g.T)
    back = np.linalg.pinv(np.eye(2) - phi)
    omega = back @ omega @ back.T
    mu, m2 = r.mean(), (r * r).mean()
    v = m2 - mu * mu
    grad = math.sqrt(annualise) * np.array([m2, -0.5 * mu]) / v**1.5
    return math.sqrt(grad @ omega @ grad / len(r))


def test_prewhitened_error_equals_matrices(spark):
    rng = np.random.default_rng(5)
    noise, r = rng.normal(0.002, 0.01, 120), [0.0]
    for x in noise:
        r.append(0.4 * r[-1] + x)
    got = robustness.prewhitened_hac(frame(spark, r), 52.0, lag=3).first()
    assert got.n == 121 and got.bandwidth == 3 and got.se == pytest.approx(plain_error(r, 3, 52.0), rel=1e-9)
    auto = robustness.prewhitened_hac(frame(spark, r), 52.0).first()
    assert auto.se == pytest.approx(plain_error(r, auto.bandwidth, 52.0), rel=1e-9)


def test_explosive_and_collinear_series(spark):
    grown = [1.05**i for i in range(40)]
    assert robustness.prewhitened_hac(frame(spark, grown), 52.0, lag=2).first().se == pytest.approx(plain_error(grown, 2, 52.0), rel=1e-5)
    two_valued = [1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0]
    assert robustness.prewhitened_hac(frame(spark, two_valued), 52.0, lag=1).first().se == pytest.approx(plain_error(two_valued, 1, 52.0), rel=1e-6)


def test_short_and_empty_series(spark):
    assert robustness.prewhitened_hac(frame(spark, [0.1] * 7), 52.0).count() == 0
    assert robustness.prewhitened_hac(spark.createDataFrame([], SCHEMA), 52.0).count() == 0


def test_inflation_is_floored(spark):
    rows = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, 0.5), ("c", 0.0, None)], "panel_id string, threshold double, sei double")
    got = {r.panel_id: tuple(r)[3:] for r in robustness.inflation(rows).collect()}
    assert got == {"a": (4.0, 4.0, 0.25, 0.25), "b": (0.25, 1.0, 4.0, 1.0), "c": (None,) * 4}


def plain_root_t(r):
    """A regression for each choice of lags."""
    n, step = len(r), np.diff(r)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(lags, start):
        y = step[start:]
        x = np.column_stack([r[start:-1], np.ones(len(y)), *(step[start - k : len(step) - k] for k in range(1, lags + 1))])
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss = float(((y - x @ beta) ** 2).sum())
        aic = len(y) * (math.log(2 * math.pi * rss / len(y)) + 1) + 2 * x.shape[1]
        return aic, beta[0] / math.sqrt((np.linalg.pinv(x.T @ x) * rss / (len(y) - x.shape[1]))[0, 0])

    return fit(*[min(range(most + 1), key=lambda k: fit(k, most)[0])] * 2)[1]


def test_unit_root_by_one_matrix():
    rng = np.random.default_rng(1)
    for n in (30, 61, 357, 2600):
        noise = rng.normal(0, 0.02, n)
        follows = np.convolve(noise, 0.6 ** np.arange(8))[:n]
        for r in (noise, noise.cumsum(), follows):
            assert abs(robustness.unit_root_t(r) - plain_root_t(r)) < 1e-8
