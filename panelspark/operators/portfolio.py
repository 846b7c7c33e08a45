"""Turnover, costs, capacity, holdouts, nested and walk-forward selection, diagnostics and gates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.special import normal_cdf, normal_quantile, sign
from panelspark.operators.aggregate import KEYS, by_threshold, date_returns, nested_weights, series_of, sharpe_of
from panelspark.operators.resample import bootstrap, inference, row_statistics, shape
from panelspark.operators.series import hac_sharpe
from panelspark.tables import written

#: Liquidity tiers (label, daily volume in dollars, daily volatility, spread in basis points).
TIERS = (("Large-cap ($200M ADV)", 200e6, 0.018, 5.0), ("Mid-cap ($50M ADV)", 50e6, 0.025, 10.0), ("Small-cap ($10M ADV)", 10e6, 0.035, 20.0))
AUM_MM = (1, 5, 10, 25, 50, 100, 250, 500)
EULER_GAMMA = 0.5772156649015329


def daily_turnover(panel: DataFrame, thresholds: tuple[float, ...], exposure: str = "as_selected") -> DataFrame:
    """Half-L1 turnover of each date against the one before: total, the part of positions that keep
    their side, and whether either date has a position."""
    weights = nested_weights(panel, thresholds, exposure)
    steps = weights.withColumn("before", F.lag("weights").over(Window.partitionBy("panel_id", "e_idx").orderBy("t_idx")))

    def figures(_: float, i: int) -> list[Column]:
        now, before = F.col("weights")[i], F.col("before")[i]
        move = 0.5 * F.abs(now - before)
        return [
            F.sum(move).alias("total"), F.sum(F.when(now * before > 0, move).otherwise(0.0)).alias("rescale"), (F.sum(F.abs(now) + F.abs(before)) > 0).alias("active"),
        ]

    return by_threshold(steps, ("panel_id", "t_idx"), thresholds, figures).select(*KEYS, "t_idx", "total", "rescale", "active")


def turnover(panel: DataFrame, thresholds: tuple[float, ...], exposure: str = "as_selected") -> DataFrame:
    """Mean half-L1 turnover of adjacent dates with an active side, and its parts: rescaling of
    positions that keep their side, and entries, exits and flips."""
    per_date = daily_turnover(panel, thresholds, exposure)
    there = F.col("active") & (F.col("t_idx") > 0)
    rest = F.greatest(F.col("total") - F.col("rescale"), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(F.when(there, c)), F.lit(0.0))
    return per_date.groupBy(*KEYS).agg(
        mean(F.col("total")).alias("daily_turnover"), mean(F.col("rescale")).alias("turnover_rescale"), mean(rest).alias("turnover_entry_exit_flip"),
        F.count_if(there).alias("n_turnover_pairs"),
    )


def cost_sensitivity(dates: DataFrame, turnovers: DataFrame, annualise: float, bps: tuple[int, ...] = (0, 1, 5, 10, 25)) -> DataFrame:
    """Gross and net Sharpe at each cost, the yearly drag and the cost that eats the mean."""
    stats = dates.groupBy(*KEYS).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), sharpe_of(F.col("ret"), annualise).alias("gross_sharpe"))
    rows = stats.join(turnovers, list(KEYS)).withColumn("cost_bps_per_rebalance", F.explode(F.array(*map(F.lit, bps))))
    drag = F.col("daily_turnover") * F.col("cost_bps_per_rebalance") / 1e4
    net = F.coalesce(F.when(F.col("sd") > 0, (F.col("mean") - drag) / F.col("sd") * annualise**0.5), F.lit(0.0))
    even = F.try_divide(F.col("mean") * 1e4, F.nullif(F.col("daily_turnover"), F.lit(0.0)))
    return rows.select(
        *KEYS, "cost_bps_per_rebalance", "daily_turnover", "turnover_rescale", "turnover_entry_exit_flip", "gross_sharpe",
        net.alias("net_sharpe"), (drag * annualise).alias("annual_cost_drag"), even.alias("break_even_cost_bps"),
    )


def holdout_windows(dates: DataFrame, annualise: float, share: float = 0.7) -> DataFrame:
    """Sharpe of the first 70 %, the last 30 % and the four quarters of the dates."""
    n = dates.groupBy("panel_id").agg((F.max("t_idx") + 1).alias("dates"))
    at = lambda x: F.floor(F.col("dates") * x).cast("int")
    spans = [("train_70pct", F.lit(0), at(share)), ("holdout_30pct", at(share), F.col("dates"))]
    spans += [(f"quarter_{i + 1}", at(i / 4), at((i + 1) / 4)) for i in range(4)]
    windows = n.select("panel_id", F.explode(F.array(*(F.struct(F.lit(w).alias("window"), a.cast("int").alias("start_idx"), b.cast("int").alias("end_idx")) for w, a, b in spans))).alias("w"))
    windows = windows.select("panel_id", "w.*")
    # six rows a panel meet the panel's dates on its key; the range is a filter
    rows = dates.join(windows, "panel_id").filter("t_idx >= start_idx and t_idx < end_idx")
    return rows.groupBy(*KEYS, "window", "start_idx", "end_idx").agg(sharpe_of(F.col("ret"), annualise).alias("sharpe"), F.count("ret").alias("n"))


def day(column: Column | str) -> Column:
    """A date as text."""
    return F.date_format(column, "yyyy-MM-dd")


def nested_selection(dates: DataFrame, annualise: float, folds: int = 5) -> DataFrame:
    """For each expanding fold, from 1, the threshold with the best Sharpe on the last 30 % of its
    training dates (the first one wins ties), and that threshold's Sharpe in and out of sample.

    Training starts with a third of the dates; test windows are equal and at least one date long, and
    dates that are left over belong to none."""
    n = dates.groupBy("panel_id").agg((F.max("t_idx") + 1).alias("dates"))
    fold = n.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("first", F.expr("dates div 3"))
    size = F.greatest(F.lit(1), F.expr(f"(dates - first) div {folds}"))
    fold = fold.withColumn("train_days", F.col("first") + (F.col("fold") - 1) * size)
    fold = fold.withColumn("test_stop", F.least(F.col("train_days") + size, "dates")).filter("test_stop > train_days")
    fold = fold.withColumn("inner", F.floor(F.col("train_days") * 0.7).cast("int"))
    rows = dates.join(F.broadcast(fold.select("panel_id", "fold", "inner", "train_days", "test_stop")), "panel_id")
    at, ret = F.col("t_idx"), F.col("ret")
    train, test = at < F.col("train_days"), (at >= F.col("train_days")) & (at < F.col("test_stop"))
    sharpe = lambda where: sharpe_of(F.when(where, ret), annualise)
    scored = rows.groupBy(*KEYS, "fold", "train_days").agg(
        sharpe(train & (at >= F.col("inner"))).alias("inner_val_sharpe"), sharpe(train).alias("is_sharpe"), sharpe(test).alias("oos_sharpe"),
        F.count(F.when(test, ret)).alias("oos_n_valid"), day(F.min("date")).alias("train_start"), day(F.max(F.when(train, F.col("date")))).alias("train_end"),
        day(F.min(F.when(test, F.col("date")))).alias("test_start"), day(F.max(F.when(test, F.col("date")))).alias("test_end"),
    )
    order = Window.partitionBy("panel_id", "fold").orderBy(F.desc("inner_val_sharpe"), "threshold")
    best = scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return best.select(
        "panel_id", "fold", "train_start", "train_end", "test_start", "test_end", F.col("threshold").alias("selected_threshold"),
        "inner_val_sharpe", "is_sharpe", "oos_sharpe", "oos_n_valid",
    )


#: Half-spread, commission and impact in basis points a side: optimistic, moderate, pessimistic.
COSTS = ((5.0, 1.0, 2.0), (10.0, 2.0, 5.0), (20.0, 5.0, 10.0))


def round_trip(spread: float, commission: float, impact: float) -> float:
    """The cost of getting in and out, in basis points."""
    return 2 * (spread + commission + impact)


def walk_forward(
    panel: DataFrame, thresholds: tuple[float, ...], annualise: float, draws: int, seed: int, folds: int = 5, costs: tuple[tuple[float, float, float], ...] = COSTS
) -> DataFrame:
    """Expanding folds, from 1, after 40 % of the dates: Sharpe in sample, and of the test window gross and
    net of each cost, with the window's own turnover, the error of its mean and its block bootstrap.

    Windows of ten dates or fewer end the folds; a threshold with fewer than ten returns in one is left out."""
    dates = written(date_returns(panel, thresholds), "walk-dates")
    n = dates.groupBy("panel_id").agg((F.max("t_idx") + 1).alias("dates"))
    fold = n.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("first", F.floor(F.col("dates") * 0.4).cast("int"))
    size = F.expr(f"(dates - first) div {folds}")
    fold = fold.withColumn("start", F.col("first") + (F.col("fold") - 1) * size).withColumn("stop", F.least(F.col("start") + size, "dates"))
    fold = F.broadcast(fold.filter("stop - start > 10").select("panel_id", "fold", "start", "stop"))
    keys = (*KEYS, "fold")
    at, ret = F.col("t_idx"), F.col("ret")
    train, test = at < F.col("start"), (at >= F.col("start")) & (at < F.col("stop"))
    rows = dates.join(fold, "panel_id")
    date = lambda where, pick: day(pick(F.when(where, F.col("date"))))
    stats = rows.groupBy(*keys).agg(
        date(train, F.min).alias("train_start"), date(train, F.max).alias("train_end"), date(test, F.min).alias("test_start"), date(test, F.max).alias("test_end"),
        F.count_if(train).alias("train_days"), F.count_if(test).alias("test_days"), sharpe_of(F.when(train, ret), annualise).alias("is_sharpe"),
        F.count(F.when(test, ret)).alias("n"), F.avg(F.when(test, ret)).alias("mean"), F.stddev_samp(F.when(test, ret)).alias("sd"),
    ).filter("n >= 10")
    moves = daily_turnover(panel, thresholds).join(fold, "panel_id").filter((at > F.col("start")) & (at < F.col("stop")) & F.col("active"))
    moves = moves.groupBy(*keys).agg(F.avg("total").alias("moved"))
    series = written(series_of(rows.filter(test & ret.isNotNull()).join(stats.select(*keys), list(keys), "left_semi"), keys), "walk-series")
    record = inference(series, bootstrap(series, "moving_block", draws, seed - 1, annualise, keys, "fold"), annualise, keys)
    error = hac_sharpe(series, annualise, keys=keys).select(*keys, F.col("mean_return_se").alias("nw_se_daily"))
    record = record.select(*keys, F.col("ci_lo").alias("oos_ci_lo"), F.col("ci_hi").alias("oos_ci_hi"), F.col("positive_p_value").alias("oos_p_value"), F.col("n_eff").alias("oos_n_effective"))
    out = stats.join(record, list(keys)).join(error, list(keys)).join(moves, list(keys), "left").withColumn("daily_turnover", F.coalesce("moved", F.lit(0.0)))
    sharpe = lambda mean: F.coalesce(F.when(F.col("sd") > 0, mean / F.col("sd") * annualise**0.5), F.lit(0.0))
    net = {round_trip(*c): F.col("mean") - F.col("daily_turnover") * (round_trip(*c) / 1e4) for c in costs}
    return out.select(
        *keys, "train_start", "train_end", "test_start", "test_end", "train_days", "test_days", "is_sharpe", sharpe(F.col("mean")).alias("oos_sharpe_gross"),
        (F.col("mean") * annualise).alias("oos_ann_ret_gross"), (F.col("sd") * annualise**0.5).alias("oos_ann_vol"), "oos_ci_lo", "oos_ci_hi", "oos_p_value",
        "oos_n_effective", "nw_se_daily", "daily_turnover",
        *(sharpe(m).alias(f"oos_sharpe_net_{bps:.0f}bps") for bps, m in net.items()), *((m * annualise).alias(f"oos_ann_ret_net_{bps:.0f}bps") for bps, m in net.items()),
    )


def capacity(panel: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Impact and viability for each size and liquidity tier, by square-root impact."""
    held = [F.coalesce(F.col("conf") >= F.lit(x), F.lit(False)) for x in thresholds]
    rows = panel.select(
        "panel_id", "t_idx", "e_idx", F.array(*(h.cast("int") for h in held)).alias("held"), F.array(*(F.when(h, sign(F.col("pred"))).otherwise(0.0) for h in held)).alias("position")
    )
    rows = rows.withColumn("before", F.lag("position").over(Window.partitionBy("panel_id", "e_idx").orderBy("t_idx")))
    per_date = by_threshold(rows, ("panel_id", "t_idx"), thresholds, lambda _, i: [F.sum(F.col("held")[i]).alias("held"), F.sum(F.abs(F.col("position")[i] - F.col("before")[i])).alias("moved")])
    moved = F.when(F.col("t_idx") > 0, F.col("moved") / F.greatest(F.col("held"), F.lit(1)))
    base = per_date.groupBy(*KEYS).agg(F.avg("held").alias("positions"), F.coalesce(F.avg(moved), F.lit(1.0)).alias("daily_turnover"))
    tier = F.explode(F.array(*(F.struct(F.lit(a).alias("liquidity_tier"), F.lit(v).alias("adv"), F.lit(s).alias("vol"), F.lit(b).alias("spread")) for a, v, s, b in TIERS)))
    rows = base.withColumn("aum_mm", F.explode(F.array(*map(F.lit, AUM_MM)))).withColumn("tier", tier).select("*", "tier.*")
    rows = rows.withColumn("participation_rate", F.col("aum_mm") * 1e6 / F.greatest("positions", F.lit(1.0)) / F.col("adv"))
    rows = rows.withColumn("impact_bps", F.col("vol") * F.sqrt("participation_rate") * 1e4)
    rows = rows.withColumn("total_rt_cost_bps", 2 * (F.col("spread") + F.col("impact_bps")))
    return rows.select(
        *KEYS, "aum_mm", "liquidity_tier", "positions", "participation_rate", "impact_bps", "total_rt_cost_bps", "daily_turnover",
        (F.col("daily_turnover") * F.col("total_rt_cost_bps") / 1e4 * 252 * 100).alias("annual_cost_drag_pct"),
        ((F.col("impact_bps") < 50) & (F.col("participation_rate") < 0.05)).alias("viable"),
    )


#: Cells (entities x dates) of one matrix, and the bounds of a block of entities.
MATRIX, LEAST_BLOCK, MOST_BLOCK = 1 << 21, 64, 2048


def same_date_correlation(panel: DataFrame, thresholds: tuple[float, ...], least: int = 10, block: int | None = None) -> DataFrame:
    """Mean correlation of the selected returns of pairs of entities with ``least`` common dates.

    Entities go in blocks of so many (as a matrix of ``MATRIX`` cells allows, unless ``block`` says so): one row an entity with
    its dates, returns and confidences as arrays. A task has a pair of blocks and returns, for all thresholds, how many pairs
    it has and the sum of their correlations; each entity goes to as many tasks as there are blocks."""
    cells = panel.filter(F.col("realised").isNotNull() & F.col("conf").isNotNull() & F.col("pred").isNotNull())
    last = panel.groupBy("panel_id").agg(F.max("e_idx").alias("e_last"), (F.max("t_idx") + 1).alias("dates"))
    fitting = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.floor(F.lit(MATRIX) / F.col("dates")))).cast("int")
    last = last.withColumn("size", fitting if block is None else F.lit(block)).withColumn("last", F.expr("e_last div size").cast("int"))
    entities = cells.groupBy("panel_id", "e_idx").agg(F.collect_list(F.struct("t_idx", "realised", "conf")).alias("cells"))
    entities = entities.select("panel_id", "e_idx", *(F.col(f"cells.{c}").alias(c) for c in ("t_idx", "realised", "conf")))
    sent = entities.join(F.broadcast(last), "panel_id").withColumn("own", F.expr("e_idx div size").cast("int"))  # a row for each panel
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    sent = sent.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def matrix(rows: pd.DataFrame, dates: int) -> tuple[np.ndarray, np.ndarray]:
        value, conf = np.zeros((len(rows), dates)), np.full((len(rows), dates), -np.inf)
        for i, (at, own, sure) in enumerate(zip(rows["t_idx"], rows["realised"], rows["conf"], strict=True)):
            value[i, at], conf[i, at] = own, sure
        return value, conf

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        low, high, dates = int(group["low"].iloc[0]), int(group["high"].iloc[0]), int(group["dates"].iloc[0])
        one, two = (matrix(group[group["own"] == k].sort_values("e_idx"), dates) for k in (low, high))
        out = []
        for threshold in thresholds:
            (x, mx), (y, my) = ((np.where(conf >= threshold, value, 0.0), (conf >= threshold).astype(float)) for value, conf in (one, two))
            n, sx, sy, sxy, sxx, syy = mx @ my.T, x @ my.T, mx @ y.T, x @ y.T, (x * x) @ my.T, mx @ (y * y).T
            with np.errstate(invalid="ignore", divide="ignore"):
                vx, vy = sxx - sx * sx / n, syy - sy * sy / n
                c = (sxy - sx * sy / n) / np.sqrt(vx * vy)
                there = (n >= least) & (vx > 1e-14 * sxx) & (vy > 1e-14 * syy) & np.isfinite(c)
            if low == high:
                there &= np.triu(np.ones_like(there), 1)
            out.append((group["panel_id"].iloc[0], threshold, int(there.sum()), float(c[there].sum())))
        return pd.DataFrame(out, columns=["panel_id", "threshold", "n", "s"])

    found = sent.groupBy("panel_id", "low", "high").applyInPandas(pairs, "panel_id string, threshold double, n long, s double")
    rho = found.groupBy(*KEYS).agg(F.try_divide(F.sum("s"), F.sum("n").cast("double")).alias("rho_same_date"))
    return panel.select("panel_id").distinct().withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).join(rho, list(KEYS), "left")


def moulton(names: Column, rho: Column) -> Column:
    """sqrt(1 + (names - 1) rho); null for a negative radicand."""
    inside = 1 + (names - 1) * rho
    return F.when(inside >= 0, F.sqrt(inside))


def deflated_sharpe(series: DataFrame, trials: int, annualise: float) -> DataFrame:
    """The odds that a series' Sharpe exceeds the best of ``trials`` null ones, for its skew and kurtosis."""
    star = 0.0
    if trials > 1:
        star = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / trials) + EULER_GAMMA * normal_quantile(1 - 1 / (trials * math.e))
    rows = shape(series).join(series.groupBy(*KEYS).agg(sharpe_of(F.col("r"), 1.0).alias("sr")), list(KEYS))
    root, sr = F.sqrt(F.col("n") - 1.0), F.col("sr")
    rows = rows.withColumn("star", F.lit(star) / root).withColumn("spread", 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr)
    z = (sr - F.col("star")) * root / F.sqrt("spread")
    enough = F.col("n") >= 5
    return rows.select(
        *KEYS, F.when(enough & (F.col("spread") > 0), normal_cdf(z)).alias("dsr"), F.when(enough, F.col("star") * annualise**0.5).alias("sr_star"),
        F.when(enough, F.col("skew")).alias("skew"), F.when(enough, F.col("kurtosis")).alias("kurtosis"),
    )


def order_size_bound(facts: DataFrame, volume: float, impact: float, z: float) -> DataFrame:
    """The largest order size that leaves an edge: V ((mean - z moulton sd / sqrt n) / (impact turnover)) ** 2; 0 without one.

    ``facts`` has mean, sd, n, moulton and daily_turnover."""
    edge = F.col("mean") - z * F.col("moulton") * F.col("sd") / F.sqrt("n")
    bound = volume * F.pow(F.try_divide(edge, impact * F.nullif(F.col("daily_turnover"), F.lit(0.0))), F.lit(2.0))
    return facts.withColumn("order_size", F.when(edge > 0, bound).otherwise(0.0))


def row_boundary(
    panel: DataFrame, dates: DataFrame, thresholds: tuple[float, ...], annualise: float, menu: DataFrame | None = None
) -> DataFrame:
    """Pooled-row inference beside the date's: row t and p, same-date correlation and its design effect,
    HAC z and p, and the menu's p_adjusted (of ``menu``, if given).

    A panel of one entity, and one with fewer than three rows or dates, has a status and no figures."""
    entities = panel.groupBy("panel_id").agg(F.countDistinct("e_idx").alias("entities"))
    counts = dates.groupBy(*KEYS).agg(F.count("ret").alias("n_dates"), F.avg(F.when(F.col("n_sel") > 0, F.col("n_sel"))).alias("avg_names"), F.sum("n_sel").alias("n_rows"))
    hac = hac_sharpe(series_of(dates), annualise).select(*KEYS, F.col("z_statistic").alias("date_hac_z"), F.col("positive_p_value").alias("hac_p_positive"))
    rows = row_statistics(panel, thresholds, annualise).drop("n_rows")
    found = counts.join(F.broadcast(entities), "panel_id").join(rows, list(KEYS), "left").join(same_date_correlation(panel, thresholds), list(KEYS), "left").join(hac, list(KEYS), "left")
    romano_wolf_p = F.lit(None).cast("double")
    if menu is not None:
        found, romano_wolf_p = found.join(menu.select(*KEYS, "p_adjusted"), list(KEYS), "left"), F.col("p_adjusted")
    status = (
        F.when(F.col("entities") < 2, "not_applicable_single_series")
        .when((F.col("n_rows") < 3) | (F.col("n_dates") < 3), "insufficient_observations")
        .otherwise("ok")
    )
    found = found.withColumn("status", status).withColumn("trading_moulton_factor", moulton(F.col("avg_names"), F.col("rho_same_date")))
    of = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    figures = ("rho_same_date", "trading_moulton_factor", "row_t_stat", "date_hac_z", "row_p_positive", "hac_p_positive")
    return found.select(*KEYS, "n_rows", "n_dates", "avg_names", *map(of, figures), romano_wolf_p.alias("romano_wolf_p"), "status")


CHECKS = ("holdout_positive", "hac", "romano_wolf", "informative", "permutation", "alpha", "net_5bps", "quarters")


def gates(facts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The eight checks, and whether all pass; applicable drops the permutation checks where the null is
    uninformative. Missing p-values fail; a panel without factors (alpha_status isn't ok) passes that check."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    informative = ok(F.col("permutation_informative")) & F.col("permutation_p").isNotNull()
    no_factors = ~ok(F.col("alpha_status") == "ok")
    checks = {
        "holdout_positive": ok(F.col("holdout_sharpe") > 0), "hac": ok(F.col("hac_p") <= alpha), "romano_wolf": ok(F.col("romano_wolf_p") <= alpha),
        "informative": informative, "permutation": informative & ok(F.col("permutation_p") <= alpha),
        "alpha": no_factors | ok((F.col("alpha_period") > 0) & (F.col("alpha_p") <= alpha)),
        "net_5bps": ok(F.col("net_sharpe_5bps") > 0), "quarters": ok(F.col("positive_quarters") >= 3),
    }
    named = facts.withColumns({f"passes_{k}": v for k, v in checks.items()})
    passes = {k: F.col(f"passes_{k}") for k in CHECKS}
    every = lambda names: F.forall(F.array(*(passes[k] for k in names)), lambda x: x)
    rest = tuple(k for k in CHECKS if k not in ("informative", "permutation"))
    return named.withColumn("passes_all", every(CHECKS)).withColumn("passes_applicable", F.when(passes["informative"], every(CHECKS)).otherwise(every(rest)))


def gate_sensitivity(facts: DataFrame, alphas: tuple[float, ...] = (0.05, 0.01)) -> DataFrame:
    """The five-check rule at several levels: HAC, bootstrap, Romano-Wolf, permutation and costs.

    A row whose status isn't ok (a candidate that failed or is missing) stays, with neither rule passed
    and its other checks unknown."""
    rows = facts.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    there = F.col("status") == "ok"
    under = lambda c: F.coalesce(F.col(c) <= F.col("alpha"), F.lit(False))
    informative = F.coalesce(F.col("permutation_informative"), F.lit(False))
    rows = rows.withColumns({
        "passes_hac": under("hac_p"), "passes_bootstrap": under("bootstrap_p"), "passes_romano_wolf": under("romano_wolf_p"),
        "passes_permutation": informative & under("permutation_p"), "passes_net_5bps": F.coalesce(F.col("net_sharpe_5bps") > 0, F.lit(False)),
    })
    base = F.col("passes_hac") & F.col("passes_bootstrap") & F.col("passes_romano_wolf") & F.col("passes_net_5bps")
    rows = rows.withColumn("passes_all", there & base & informative & F.col("passes_permutation"))
    rows = rows.withColumn("passes_applicable", there & base & (F.col("passes_permutation") | ~informative))
    rows = rows.withColumn("permutation_status", F.when(there, F.col("permutation_status")).otherwise(F.col("status")))
    rows = rows.withColumn("permutation_informative", there & informative)
    return rows.withColumns({c: F.when(there, F.col(c)) for c in ("passes_hac", "passes_bootstrap", "passes_romano_wolf", "passes_permutation", "passes_net_5bps")})


def gate_counts(sensitivity: DataFrame) -> DataFrame:
    """At each level, how many candidates there are and how many pass either rule."""
    return sensitivity.groupBy("alpha").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("passes_all").alias("n_full_passes"), F.count_if("passes_applicable").alias("n_applicable_passes")
    )


#: The texts of a status.
FULL = "Passes full evaluation"
UNINFORMATIVE = "Permutation uninformative; remaining applicable checks pass"
PERMUTATION_FAILS = "Fails permutation check"
BOTH_FAIL = "Fails statistical and cost checks"
COST_FAILS = "Fails cost check"
OTHERWISE = "Does not pass full evaluation"


def status_label(gated: DataFrame) -> DataFrame:
    """audit_p, the largest p-value of the date level (the permutation's if it is informative), and status_label,
    a line of text for each gated row: the first rule that fits.

    A row whose pooled rows look significant though the dates don't is the one that the evaluation is there to catch."""
    own = F.when(F.coalesce("permutation_informative", F.lit(False)), F.col("permutation_p"))
    audit = F.greatest("hac_p", "romano_wolf_p", own)
    known = lambda c: F.coalesce(c, F.lit(False))
    statistics, cost = known(audit > 0.05), known(F.col("net_sharpe_5bps") <= 0)
    label = (
        F.when(known(F.col("passes_all")), FULL)
        .when(known(F.lower("permutation_status") == "degenerate") & known(F.col("passes_applicable")), UNINFORMATIVE)
        .when(known(F.col("row_p") <= 0.05) & statistics, PERMUTATION_FAILS)
        .when(statistics & cost, BOTH_FAIL)
        .when(cost, COST_FAILS)
        .otherwise(OTHERWISE)
    )
    return gated.withColumn("audit_p", audit).withColumn("status_label", label)


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a work list whose keys aren't among the finished ones."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
