"""Resampling of SERIES: bootstraps and menu tests, permutations of the panel, corrections.

A series is one value a date, a bounded array: it goes to a task for each block of draws,
which returns one number a draw, or a sum over its draws. Panels are cut into blocks of
dates as well, whose sums Spark adds up. Random numbers are hashed counters of (seed, draw,
place), so results depend on neither partitioning nor retries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.special import counter_arrays, student_upper
from panelspark.operators.aggregate import KEYS, by_threshold, selected, sharpe_of
from panelspark.operators.panel import along_time, compounded, rank_confidence, raw_returns
from panelspark.operators.series import block_lengths, effective_size
from panelspark.tables import spread

METHODS = ("iid", "moving_block", "stationary", "cluster_date")
#: Draws of one task, dates of one block of a panel, and cells that a task deals anew at once.
BLOCK, DATES, CELLS = 200, 32, 1 << 18


def counters(seed: int, draws: np.ndarray, n: int) -> np.ndarray:
    """Uniform numbers below 2 ** 32 for each draw and place below ``n``, as :func:`special.counter` gives them.

    They don't depend on the series, so the series of one task share those of the longest one so far."""
    key = (seed, int(draws[0]), len(draws))
    held = _COUNTERS.get(key)
    if held is None or held.shape[1] < n:
        if len(_COUNTERS) > 4:
            _COUNTERS.clear()
        held = _COUNTERS[key] = counter_arrays(seed, draws[:, None], np.arange(n))
    return held[:, :n]


_COUNTERS: dict[tuple[int, int, int], np.ndarray] = {}


def drawn_places(method: str, n: int, size: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """Which of ``n`` values stands at each place of each draw.

    iid (cluster_date: dates are the values): any value; moving_block: runs of ``size`` that
    don't wrap; stationary: runs that end with odds 1 / size, wrapping around."""
    if method == "moving_block":
        starts = counters(seed, draws, -(-n // size)) % (n - size + 1)
        return (starts[:, :, None] + np.arange(size)).reshape(len(draws), -1)[:, :n]
    any_place = counters(seed, draws, n) % n
    if method in ("iid", "cluster_date"):
        return any_place
    if method != "stationary":
        raise ValueError(f"unknown method {method}")
    new = counters(seed + 1, draws, n) * size < 2**32
    new[:, 0] = True
    last = np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1)
    return (np.take_along_axis(any_place, last, axis=1) + np.arange(n) - last) % n


def sharpe_rows(values: np.ndarray, annualise: float) -> np.ndarray:
    """The Sharpe ratio of each row; 0 without spread."""
    spread = values.std(axis=1, ddof=1) if values.shape[1] > 1 else np.zeros(len(values))
    return np.where(spread > 0, values.mean(axis=1) / np.where(spread > 0, spread, 1.0) * annualise**0.5, 0.0)


def draw_blocks(rows: DataFrame, draws: int) -> DataFrame:
    """Each row with ``first``, the first draw of each block."""
    return rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(BLOCK))))


def bootstrap(
    series: DataFrame, method: str, draws: int, seed: int, annualise: float, keys: tuple[str, ...] = KEYS, shifted_by: str | None = None
) -> DataFrame:
    """keys, method, draw and sharpe of every draw. ``shifted_by`` names a key to add to the seed."""
    whole = series.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("u", "r"))), lambda x: x["r"]).alias("values"))
    work = draw_blocks(whole.join(block_lengths(series, keys=keys), list(keys)), draws)
    types = dict(series.dtypes)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                own = np.arange(row["first"], min(row["first"] + BLOCK, draws))
                x = np.asarray(row["values"], dtype=float)
                at = drawn_places(method, len(x), int(row["block_size"]), own, seed + (row[shifted_by] if shifted_by else 0))
                yield pd.DataFrame({**{k: row[k] for k in keys}, "method": method, "draw": own, "sharpe": sharpe_rows(x[at], annualise)})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", method string, draw int, sharpe double"
    return spread(work, keys[0], "first").mapInPandas(draw, schema)  # a panel's series share a block's random numbers


def draw_summary(draws: DataFrame, keys: tuple[str, ...] = (*KEYS, "method"), confidence: float = 0.95) -> DataFrame:
    """se, percentile interval and smoothed p-value (1 + draws not above 0) / (1 + draws)."""
    tail = (1 - confidence) / 2
    ends = F.percentile("sharpe", F.array(F.lit(tail), F.lit(1 - tail)))
    return (
        draws.groupBy(*keys)
        .agg(F.stddev_samp("sharpe").alias("se"), ends.alias("ends"), ((1 + F.count_if(F.col("sharpe") <= 0)) / (1 + F.count("sharpe"))).alias("p_positive"))
        .select(*keys, "se", F.col("ends")[0].alias("ci_lo"), F.col("ends")[1].alias("ci_hi"), "p_positive")
    )


def dated_blocks(panel: DataFrame, group: Column | None = None) -> DataFrame:
    """The rows of a panel (t_idx, e_idx, raw, pred, realised, conf) with ``dates`` (the number of a block of ``DATES`` dates),
    grp and width (the panel's entities): plain columns, which a task gets a block at a time."""
    rows = panel if "raw" in panel.columns else raw_returns(panel)
    width = panel.groupBy("panel_id").agg((F.max("e_idx") + 1).alias("width"))
    own = (F.lit(0) if group is None else group).cast("long")
    cells = rows.select("panel_id", F.expr(f"t_idx div {DATES}").alias("dates"), "t_idx", "e_idx", *_FIELDS, own.alias("grp"))
    return spread(cells.join(F.broadcast(width), "panel_id"), "panel_id", "dates")  # width is a row for each panel


_FIELDS = ("raw", "pred", "realised", "conf")


def _matrices(rows: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The dates of a block, and each field as a matrix of dates x entities, NaN where there is nothing."""
    dates, at = np.unique(rows["t_idx"].to_numpy(), return_inverse=True)
    entity, out = rows["e_idx"].to_numpy(), {}
    for name in _FIELDS:
        out[name] = np.full((len(dates), int(rows["width"].iloc[0])), np.nan)
        out[name][at, entity] = rows[name].to_numpy(dtype=float)
    return dates, out


def _selected_mean(pred: np.ndarray, conf: np.ndarray, realised: np.ndarray, weight: np.ndarray | float, threshold: float, exposure: str) -> np.ndarray:
    """The return of each date (NaN: none) of what a threshold selects."""
    with np.errstate(invalid="ignore", divide="ignore"):
        there = (conf >= threshold) & np.isfinite(realised) & np.isfinite(pred)
        mean = lambda held: (np.where(held, weight * realised, 0.0).sum(axis=-1)) / (held * weight).sum(axis=-1)
        if exposure == "as_selected":
            out = mean(there)
        elif exposure == "dollar_neutral":
            out = 0.5 * mean(there & (pred > 0)) + 0.5 * mean(there & (pred < 0))
        else:
            raise ValueError(f"unknown exposure {exposure}")
    return np.where(np.isfinite(out), out, np.nan)


def sharpe_of_sums(sums: DataFrame, keys: list[str], annualise: float) -> DataFrame:
    """keys and sharpe from numbers, sums and sums of squares (n, s1, s2) of blocks of dates."""
    n, s1, s2 = (F.sum(c) for c in ("n", "s1", "s2"))
    variance = (s2 - s1 * s1 / n) / (n - 1)
    # what rounding leaves of no spread at all is none
    value = F.when((n > 1) & (variance > 1e-14 * s2 / n), s1 / n / F.sqrt(variance) * annualise**0.5)
    return sums.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("sharpe"))


def entity_bootstrap(panel: DataFrame, thresholds: tuple[float, ...], draws: int, seed: int, annualise: float) -> DataFrame:
    """Sharpe of each draw of N entities with replacement; an entity drawn m times weighs m.

    A task has a block of dates, once, and goes through all draws."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        _, m = _matrices(rows)
        width, out = m["conf"].shape[1], []
        step = max(1, min(BLOCK, CELLS // width))
        held = {x: (m["conf"] >= x) & np.isfinite(m["realised"]) & np.isfinite(m["pred"]) for x in thresholds}
        for first in range(0, draws, step):
            own = np.arange(first, min(first + step, draws))
            drawn = counter_arrays(seed, own[:, None], np.arange(1, width + 1)) % width  # places count from 1
            weight = np.bincount((drawn + np.arange(len(own))[:, None] * width).ravel(), minlength=len(own) * width).reshape(len(own), width).astype(float)
            for threshold, there in held.items():
                total = weight @ there.T.astype(float)
                with np.errstate(invalid="ignore", divide="ignore"):
                    ret = (weight @ np.where(there, m["realised"], 0.0).T) / total
                ret = np.where(total > 0, ret, 0.0)
                out.append(_sums(rows, threshold, "draw", own, (total > 0).sum(axis=1), ret))
        return pd.concat(out)

    sums = dated_blocks(panel).groupBy("panel_id", "dates").applyInPandas(draw, "panel_id string, threshold double, draw int, n long, s1 double, s2 double")
    found = sharpe_of_sums(sums, [*KEYS, "draw"], annualise)
    return found.select(*KEYS, F.lit("cluster_entity").alias("method"), "draw", "sharpe")


def _sums(rows: pd.DataFrame, threshold: float, name: str, own: np.ndarray, n: np.ndarray, ret: np.ndarray) -> pd.DataFrame:
    """Number, sum and sum of squares of each row of returns (0 where there is none)."""
    return pd.DataFrame({"panel_id": rows["panel_id"].iloc[0], "threshold": threshold, name: own, "n": n, "s1": ret.sum(axis=1), "s2": (ret * ret).sum(axis=1)})


def menu_rows(dates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The menu's returns on the dates that any strategy has, and its block length."""
    some = dates.groupBy("panel_id", "t_idx").agg(F.count("ret").alias("some"), F.avg("ret").alias("r")).filter("some > 0")
    u = F.row_number().over(Window.partitionBy("panel_id").orderBy("t_idx")) - 1
    some = some.withColumn("u", u)
    block = block_lengths(some.select("panel_id", "u", "r"), keys=("panel_id",))
    return dates.join(some.select("panel_id", "t_idx", "u"), ["panel_id", "t_idx"]).select(*KEYS, "u", "ret"), block


def _t_rows(values: np.ndarray, count: np.ndarray | int) -> np.ndarray:
    """mean / (sd / sqrt(n)) along the first axis, null values left out; 0 without spread."""
    mean, spread = np.nanmean(values, axis=0), np.nanstd(values, axis=0, ddof=1)
    return np.where(spread > 0, mean / np.where(spread > 0, spread / np.sqrt(count), 1.0), 0.0)


def _menu(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The thresholds of a menu and its returns, dates x thresholds, NaN where there is none."""
    cells = pd.DataFrame.from_records([c.asDict() if hasattr(c, "asDict") else c for c in row["cells"]])
    wide = cells.pivot(index="u", columns="threshold", values="ret")
    return wide.columns.to_numpy(dtype=float), wide.to_numpy(dtype=float)


def menu_tests(dates: DataFrame, draws: int, seed: int) -> DataFrame:
    """For each threshold of a panel's menu (block sums, to be added): step (by falling t statistic), t_stat,
    mean, and how many joint block draws reach it: marginally, among the steps from its own on, and in the best mean."""
    rows, block = menu_rows(dates)
    whole = rows.groupBy("panel_id").agg(F.collect_list(F.struct("threshold", "u", "ret")).alias("cells"))
    work = draw_blocks(whole.join(block, "panel_id"), draws)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                thresholds, values = _menu(row)
                n, count = len(values), np.isfinite(values).sum(axis=0)
                own = np.arange(row["first"], min(row["first"] + BLOCK, draws))
                observed, mean = _t_rows(values, np.maximum(count, 1)), np.nanmean(values, axis=0)
                order = np.lexsort((thresholds, observed))[::-1]
                centred = np.nan_to_num(values - mean)
                at = drawn_places("moving_block", n, int(row["block_size"]), own, seed)
                drawn = centred[at]  # draws x dates x thresholds
                spread = drawn.std(axis=1, ddof=1)
                means = drawn.mean(axis=1)
                t = np.where(spread > 0, means / np.where(spread > 0, spread / np.sqrt(n), 1.0), 0.0)
                highest = np.maximum.accumulate(t[:, order[::-1]], axis=1)[:, ::-1]
                above = np.empty(len(thresholds), dtype=np.int64)
                above[order] = (highest >= observed[order]).sum(axis=0)
                step = np.empty(len(thresholds), dtype=np.int64)
                step[order] = np.arange(len(order)) + 1
                yield pd.DataFrame({
                    "panel_id": row["panel_id"], "threshold": thresholds, "n_dates": n, "block_size": int(row["block_size"]), "step": step, "t_stat": observed,
                    "mean": mean, "raw": (t >= observed).sum(axis=0), "above": above, "best": int((means.max(axis=1) >= mean.max()).sum()),
                })

    schema = "panel_id string, threshold double, n_dates int, block_size int, step int, t_stat double, mean double, raw long, above long, best long"
    found = spread(work, "panel_id", "first").mapInPandas(draw, schema)
    fixed = ("n_dates", "block_size", "step", "t_stat", "mean")
    return found.groupBy(*KEYS).agg(*(F.first(c).alias(c) for c in fixed), *(F.sum(c).alias(c) for c in ("raw", "above", "best")))


def romano_wolf(dates: DataFrame, draws: int, seed: int) -> DataFrame:
    """t_stat, p_raw and step-down p_adjusted of each threshold, from one joint block bootstrap;
    ones on fewer than ten dates."""
    found = menu_tests(dates, draws, seed)
    enough = F.col("n_dates") >= 10
    smooth = lambda c: (1 + F.col(c)) / F.lit(draws + 1.0)
    running = F.max(smooth("above")).over(Window.partitionBy("panel_id").orderBy("step"))
    rows = found.withColumn("p_raw", smooth("raw")).withColumn("p_step", running)
    adjusted = F.greatest(F.least(F.col("p_step"), F.lit(1.0)), "p_raw")
    return rows.select(
        *KEYS, F.when(enough, F.col("t_stat")).otherwise(0.0).alias("t_stat"), F.when(enough, F.col("p_raw")).otherwise(1.0).alias("p_raw"),
        F.when(enough, adjusted).otherwise(1.0).alias("p_adjusted"), F.when(enough, F.col("block_size")).alias("block_size"),
    )


def white_reality_check(dates: DataFrame, draws: int, seed: int) -> DataFrame:
    """The best mean of the menu and its p-value against the best of centred draws."""
    found = menu_tests(dates, draws, seed).groupBy("panel_id").agg(
        F.max("mean").alias("observed_max_mean"), ((1 + F.max("best")) / F.lit(draws + 1.0)).alias("p_value"), F.max("block_size").alias("block_size")
    )
    return found


def permuted_sharpe(
    panel: DataFrame, thresholds: tuple[float, ...], perms: int, seed: int, annualise: float, group: Column | None = None, exposure: str = "as_selected"
) -> DataFrame:
    """NULL_DRAWS: panel_id, threshold, perm, seed (with perm it gives the draw again) and sharpe with (pred, conf) dealt anew among the
    entities of a date (and of a group, if one is given). A task has a block of dates, once, goes through all
    permutations and returns sums; each entity's turn is a counter of (seed, perm, t_idx, e_idx)."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        dates, m = _matrices(rows)
        width, out = m["conf"].shape[1], []
        pool = np.zeros(width, dtype=np.int64)
        pool[rows["e_idx"].to_numpy()] = rows["grp"].to_numpy()
        places = np.argsort(pool, kind="stable")
        step = max(1, CELLS // (len(dates) * width))
        for first in range(0, perms, step):
            own = np.arange(first, min(first + step, perms))
            keys = counter_arrays(seed, own[:, None, None], dates[None, :, None], np.arange(width)) + (pool << 32)
            order = np.empty_like(keys)
            order[..., places] = np.argsort(keys, axis=-1, kind="stable")
            pred, conf = (np.take_along_axis(np.broadcast_to(m[c], keys.shape), order, axis=-1) for c in ("pred", "conf"))
            side = np.nan_to_num(np.sign(pred))
            realised = np.where(side != 0, side * m["raw"], np.nan)
            for threshold in thresholds:
                ret = _selected_mean(pred, conf, realised, 1.0, threshold, exposure)
                there = np.isfinite(ret)
                out.append(_sums(rows, threshold, "perm", own, there.sum(axis=1), np.where(there, ret, 0.0)))
        return pd.concat(out)

    sums = dated_blocks(panel, group).groupBy("panel_id", "dates").applyInPandas(deal, "panel_id string, threshold double, perm int, n long, s1 double, s2 double")
    return sharpe_of_sums(sums, [*KEYS, "perm"], annualise).select(*KEYS, "perm", F.lit(seed).alias("seed"), "sharpe")


def null_summary(draws: DataFrame, observed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Null mean, sd, quantiles and p-value; a null without spread is degenerate and gives no p-value.

    ``observed`` has keys, observed_sharpe and entities; a panel of one entity has nothing to permute."""
    quantiles = F.percentile("sharpe", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    found = (
        draws.groupBy(*keys)
        .agg(
            F.avg("sharpe").alias("null_mean"), F.stddev_samp("sharpe").alias("null_sd"), quantiles.alias("q"), F.collect_list("sharpe").alias("all"),
            F.count(F.lit(1)).alias("n_perms"), F.countDistinct("sharpe").alias("kinds"),
        )
    )
    single = F.col("entities") < 2
    rows = observed.join(found, list(keys), "left").withColumn("n_perms", F.when(single, 0).otherwise(F.coalesce("n_perms", F.lit(0))))
    informative = F.coalesce(~single & (F.col("n_perms") > 0) & (F.col("kinds") > 1) & (F.col("null_sd") > 1e-10), F.lit(False))
    status = (
        F.when(single, "not_applicable_single_series").when(F.col("n_perms") == 0, "insufficient_permutation_draws")
        .when(informative, "ok").otherwise("degenerate")
    )
    above = F.size(F.filter("all", lambda x: x >= F.col("observed_sharpe")))
    of = lambda c: F.when(~single, c)
    return rows.select(
        *keys, "observed_sharpe", of(F.col("null_mean")).alias("null_mean"), of(F.col("null_sd")).alias("null_sd"),
        *(of(F.col("q")[i]).alias(name) for i, name in enumerate(("null_q025", "null_q500", "null_q975"))),
        F.when(informative, (1 + above) / (1 + F.col("n_perms"))).alias("p_positive"), F.col("n_perms").cast("long").alias("n_perms"),
        status.alias("status"), informative.alias("permutation_informative"),
    )


def corrections(p_values: DataFrame, keys: tuple[str, ...] = ("panel_id",), storey_lambda: float = 0.5) -> DataFrame:
    """Bonferroni, Holm, Benjamini-Hochberg, Benjamini-Yekutieli and Storey values of ``p`` within the keys."""
    family = Window.partitionBy(*keys)
    up, down = family.orderBy("p", "threshold"), family.orderBy(F.desc("p"), F.desc("threshold"))
    m = F.count("p").over(family)
    rows = p_values.withColumn("m", m).withColumn("rank", F.row_number().over(up))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    pi0 = F.least(F.lit(1.0), F.avg((F.col("p") > storey_lambda).cast("double")).over(family) / (1 - storey_lambda))
    rows = rows.withColumn("scaled", F.col("p") * F.col("m") / F.col("rank")).withColumn("harmonic", harmonic).withColumn("pi0", pi0)
    lowest = F.min("scaled").over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("lowest", lowest)
    one = F.lit(1.0)
    holm = F.max(F.least(one, F.col("p") * (F.col("m") - F.col("rank") + 1))).over(up)
    lowest_by = F.min(F.col("scaled") * F.col("harmonic")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(
        *keys, "threshold", "p", F.least(one, F.col("p") * F.col("m")).alias("p_bonferroni"), holm.alias("p_holm"), F.least(one, "lowest").alias("p_bh"),
        F.least(one, lowest_by).alias("p_by"), F.least(one, F.col("lowest") * F.col("pi0")).alias("q_storey"),
    )


def shape(series: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, bias-corrected skewness and kurtosis (3 for a normal one) of each series."""
    n = F.col("n").cast("double")
    rows = series.groupBy(*keys).agg(F.count("r").alias("n"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    return rows.select(
        *keys, "n",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3).alias("kurtosis"),
    )


def inference(series: DataFrame, draws: DataFrame, annualise: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The inference record of each series and method of ``draws``: point and bootstrap error, interval
    and p-value; the mean with its error at the effective size, and t with n_eff - 1 degrees of
    freedom. Series of fewer than ten values have none."""
    base = series.groupBy(*keys).agg(F.count("r").alias("n_nominal"), F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("sd"), sharpe_of(F.col("r"), annualise).alias("sharpe"))
    base = base.filter("n_nominal >= 10").join(effective_size(series, keys=keys).select(*keys, "n_eff"), list(keys))
    base = base.join(block_lengths(series, keys=keys).select(*keys, "block_size"), list(keys))
    base = base.withColumn("mean_return_se", F.col("sd") / F.sqrt("n_eff"))
    base = base.withColumn("t_statistic", F.when(F.col("mean_return_se") > 0, F.col("mean_return") / F.col("mean_return_se")).otherwise(float("inf")))
    upper = student_upper(F.col("t_statistic"), F.greatest(F.lit(1.0), F.col("n_eff") - 1))
    base = base.withColumn("upper", upper).withColumn("two_sided_p_value", 2 * F.least(F.col("upper"), 1 - F.col("upper")))
    return base.join(draw_summary(draws, (*keys, "method")), list(keys)).select(
        *keys, "method", "sharpe", "se", "ci_lo", "ci_hi", "mean_return", "mean_return_se", "t_statistic", F.col("p_positive").alias("positive_p_value"),
        "two_sided_p_value", "n_eff", "n_nominal", "block_size",
    )


def compared_methods(panel: DataFrame, series: DataFrame, thresholds: tuple[float, ...], draws: int, seed: int, annualise: float) -> DataFrame:
    """The inference records of the five methods side by side."""
    every = entity_bootstrap(panel, thresholds, draws, seed, annualise)
    for method in METHODS:
        every = every.unionByName(bootstrap(series, method, draws, seed, annualise))
    return inference(series, every, annualise)


def menu_table(panel: DataFrame, dates: DataFrame, series: DataFrame, draws: int, seed: int, annualise: float, correction: str = "holm") -> DataFrame:
    """Each threshold's inference (block bootstrap), its corrected p-value and whether both are under 0.05.

    A threshold of fewer than 30 dates has a p-value of 1 and no other figures. n_predictions counts
    confidences alone, avg_names also dates without any."""
    record = inference(series, bootstrap(series, "moving_block", draws, seed, annualise), annualise)
    sizes = dates.groupBy(*KEYS).agg(F.count("ret").alias("n_dates"))
    thresholds = tuple(sorted(r[0] for r in dates.select("threshold").distinct().collect()))  # the menu: a few values
    names = by_threshold(panel, ("panel_id",), thresholds, lambda x, _: [
        F.count_if(F.col("conf") >= F.lit(x)).alias("n_predictions"), F.count_if((F.col("conf") >= F.lit(x)) & F.col("realised").isNotNull()).alias("names"),
    ]).join(panel.groupBy("panel_id").agg(F.countDistinct("t_idx").alias("dates")), "panel_id")
    names = names.select(*KEYS, "n_predictions", (F.col("names") / F.col("dates")).alias("avg_names"))
    rows = sizes.join(names, list(KEYS)).join(record, list(KEYS), "left")
    enough = F.col("n_dates") >= 30
    rows = rows.select(
        *KEYS, *(F.when(enough, F.col(c)).alias(c) for c in ("sharpe", "se", "ci_lo", "ci_hi", "n_eff", "block_size")),
        F.when(enough, F.col("positive_p_value")).otherwise(1.0).alias("p_raw"), "n_dates", "n_predictions", F.when(F.col("n_dates") > 0, F.col("avg_names")).alias("avg_names"),
    )
    if correction == "romano_wolf":
        adjusted = romano_wolf(dates, draws, seed).select(*KEYS, "p_adjusted")
    else:
        column = {"holm": "p_holm", "bh": "p_bh", "by": "p_by", "storey": "q_storey", "bonferroni": "p_bonferroni", "none": "p"}[correction]
        adjusted = corrections(rows.select(*KEYS, F.col("p_raw").alias("p"))).select(*KEYS, F.col(column).alias("p_adjusted"))
    rows = rows.join(adjusted, list(KEYS))
    return rows.withColumn("significant_raw", F.col("p_raw") < 0.05).withColumn("significant_adjusted", F.col("p_adjusted") < 0.05)


def t_statistics(value: Column) -> Column:
    """mean / (sd / sqrt(n)); null where there is no spread."""
    spread = F.stddev_samp(value)
    return F.when(spread > 0, F.avg(value) / (spread / F.sqrt(F.count(value))))


def row_statistics(panel: DataFrame, thresholds: tuple[float, ...], annualise: float) -> DataFrame:
    """All selected rows pooled, as if they were independent: n_rows, t statistic and its p-value by
    Student's distribution; Sharpe ratio with its iid error, interval and normal p-value
    (null below five rows)."""

    def figures(threshold: float, _: int) -> list[Column]:
        value = F.when(selected(threshold), F.col("realised"))
        return [F.count(value).alias("n_rows"), t_statistics(value).alias("row_t_stat"), sharpe_of(value, annualise).alias("row_sharpe"), sharpe_of(value, 1.0).alias("period")]

    found = by_threshold(panel, ("panel_id",), thresholds, figures).filter("n_rows > 0")
    se = F.when(F.col("n_rows") >= 5, F.sqrt(annualise * (1 + 0.5 * F.col("period") * F.col("period")) / F.col("n_rows")))
    found = found.withColumn("row_sharpe_se", se).withColumn("row_p_positive", student_upper(F.col("row_t_stat"), F.greatest(F.lit(1.0), F.col("n_rows") - 1.0)))
    return found.select(
        *KEYS, "n_rows", "row_t_stat", "row_p_positive", F.when(F.col("n_rows") >= 5, F.col("row_sharpe")).alias("row_sharpe"), "row_sharpe_se",
        (F.col("row_sharpe") - 1.96 * F.col("row_sharpe_se")).alias("row_ci_lo"), (F.col("row_sharpe") + 1.96 * F.col("row_sharpe_se")).alias("row_ci_hi"),
    )


def signal_panel(returns: DataFrame, lookback: int, skip: int) -> DataFrame:
    """The cells of a momentum panel before positions are taken: signals, the ranks of all of them, and the
    next date's returns (raw), whether or not a signal stands beside one."""
    scored = returns.withColumn("pred", compounded(F.col("ret"), lookback, skip)).withColumn("raw", F.lead("ret").over(along_time()))
    ranked = scored.withColumn("conf", rank_confidence(F.abs("pred")))
    return ranked.select("panel_id", "t_idx", "e_idx", "raw", "pred", F.lit(None).cast("double").alias("realised"), "conf")
