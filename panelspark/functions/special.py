"""Special functions and random numbers as Spark expressions, with their SQL text.

Expressions stay inside generated code; the text forms let the same formula run in
another SQL engine. Random numbers are counters mixed by whole-number arithmetic that every engine has, so they
depend on neither partitioning nor retries.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published rational Chebyshev fit of the complementary error
#: function (relative error about 1.2e-7), lowest power first.
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def finite(x: Column) -> Column:
    """``x``, with NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def sign(x: Column, tolerance: float = 0.0) -> Column:
    """1, -1, or 0 for what lies within the tolerance or is null."""
    return F.when(x > tolerance, 1.0).when(x < -tolerance, -1.0).otherwise(0.0)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    power = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        power = F.lit(c) + t * power
    tail = 0.5 * t * F.exp(-x * x + power)
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    """The text of :func:`normal_cdf`."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * {x}))"
    power = f"({ERFC_FIT[-1]}::DOUBLE)"
    for c in reversed(ERFC_FIT[:-1]):
        power = f"(({c})::DOUBLE + {t} * {power})"
    tail = f"(0.5::DOUBLE * {t} * exp(-{x} * {x} + {power}))"
    return f"(CASE WHEN {z} >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END)"


def normal_quantile(p: float) -> float:
    """The standard normal quantile of a constant."""
    return NormalDist().inv_cdf(p)


#: Odd numbers of the counters: what the two lanes start from and the second adds, and the multiplier of a round.
LANES, SECOND, FACTOR, ROUNDS = (0x9E3779B9, 0x85EBCA6B), 0xC2B2AE35, 0x45D9F3B, 3
LOW_BITS = 0xFFFFFFFF


def _mixed(x: Column) -> Column:
    """A number below 2 ** 32 with its bits spread: rounds of a shift and a product, which stay below 2 ** 63."""
    return F.aggregate(F.array(*[F.lit(0)] * ROUNDS), x.cast("long"), lambda v, _: (v.bitwiseXOR(F.shiftright(v, 16)) * FACTOR).bitwiseAND(LOW_BITS))


def counter(seed: int, *parts: Column) -> Column:
    """A uniform integer below 2 ** 32 for each combination of ``parts``, whole numbers.

    All parts but the last go into two lanes of 32 bits, started apart; the last is mixed with both."""
    add = lambda v, p, more=0: _mixed((v + p.cast("long") + more).bitwiseAND(LOW_BITS))
    a, b = (_mixed(F.lit((seed + start) & LOW_BITS)) for start in LANES)
    for part in parts[:-1]:
        a, b = add(a, part), add(b, part, SECOND)
    return _mixed(add(a, parts[-1]).bitwiseXOR(b))


def counter_sql(seed: int | str, *parts: str) -> str:
    """The text of :func:`counter`; the seed may be an expression."""
    mixed = lambda x: f"list_reduce([({x}) & {LOW_BITS}{', 0' * ROUNDS}], lambda v, z: (xor(v, v >> 16) * {FACTOR}) & {LOW_BITS})"
    a, b = (mixed(f"({seed})::BIGINT + {start}") for start in LANES)
    for part in parts[:-1]:
        a, b = mixed(f"{a} + ({part})::BIGINT"), mixed(f"{b} + ({part})::BIGINT + {SECOND}")
    return mixed(f"xor({mixed(f'{a} + ({parts[-1]})::BIGINT')}, {b})")


def mixed_array(x: np.ndarray) -> np.ndarray:
    """:func:`counter`'s mixing of an array of unsigned numbers of 32 bits, whose products wrap."""
    for _ in range(ROUNDS):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(FACTOR)
    return x


def counter_arrays(seed: int, *parts: np.ndarray) -> np.ndarray:
    """:func:`counter` of arrays that fit each other's shapes, as 64-bit numbers."""
    few = lambda x: (np.atleast_1d(x).astype(np.int64) & LOW_BITS).astype(np.uint32)
    a, b = (mixed_array(few([seed + start])) for start in LANES)
    for part in parts[:-1]:
        a, b = mixed_array(a + few(part)), mixed_array(b + few(part) + np.uint32(SECOND))
    return mixed_array(mixed_array(a + few(parts[-1])) ^ b).astype(np.int64)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.clip(np.where(turned, 1 - x, x), 0.0, 1.0)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    # convergents of 1 / (1 + d1 / (1 + d2 / ..)), from the last term backwards
    below = np.ones_like(y)
    for i in range(300, 0, -1):
        m = i // 2
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        below = 1.0 + (odd if i % 2 else even) / below
    value = np.where(y <= 0, 0.0, front / below)
    return np.where(turned, 1.0 - value, value)


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's distribution, for any positive degrees of freedom."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(over="ignore", invalid="ignore"):
        tail = 0.5 * incomplete_beta(df / 2, np.float64(0.5), np.where(np.isinf(t), 0.0, df / (df + t * t)))
    return np.where(t >= 0, tail, 1.0 - tail)


def student_upper(t: Column, df: Column) -> Column:
    """P(T > t) for columns of statistics and degrees of freedom; null where either is null or df <= 0."""

    @F.pandas_udf("double")
    def of_batch(values: pd.Series, freedoms: pd.Series) -> pd.Series:
        ok = values.notna() & (freedoms > 0)
        out = pd.Series(np.nan, index=values.index)
        out[ok] = student_tail(values[ok].to_numpy(), freedoms[ok].to_numpy())
        return out.astype(object).where(ok, None)

    return of_batch(t.cast("double"), df.cast("double"))


def student_upper_sql(t: str, df: str) -> str:
    """The same in SQL: Simpson's rule over the density, 400 steps from 0 to |t|."""
    weight = "CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"abs({t}) / 1200 * list_sum(list_transform(range(0, 401), lambda i: ({weight}) * pow(1 + pow(abs({t}) * i / 400, 2) / ({df}), -(({df}) + 1) / 2)))"
    return f"(0.5 - sign({t}) * {area} * exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(({df}) * pi()))"
