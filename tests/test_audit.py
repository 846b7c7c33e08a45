"""Validation operators, gates, reports and checks on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_panel import long_panel, returns_frame, series_frame

from panelspark.functions import special
from panelspark.operators import aggregate, dependence, factors, panel, portfolio, reports, resample, robustness, validation


def gated(spark, **changes):
    row = {
        "panel_id": "p", "threshold": 0.5, "holdout_sharpe": 0.5, "hac_p": 0.01, "romano_wolf_p": 0.02, "net_sharpe_5bps": 0.1, "positive_quarters": 3, "permutation_informative": True,
        "permutation_p": 0.01, "permutation_status": "ok", "alpha_status": "not_applicable", "alpha_period": None, "alpha_p": None, "row_p": 0.001, "bootstrap_p": 0.01, "status": "ok", "candidate_id": "c",
    } | changes
    kinds = {str: "string", float: "double", int: "int", bool: "boolean", type(None): "double"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))


@pytest.mark.parametrize(("changes", "full", "applicable", "label"), [
    ({}, True, True, "Passes full evaluation"),
    ({"permutation_informative": False, "permutation_p": None, "permutation_status": "degenerate"}, False, True, "Permutation uninformative; remaining applicable checks pass"),
    ({"permutation_p": 0.2}, False, False, "Fails permutation check"),
    ({"hac_p": 0.2, "row_p": 0.3, "net_sharpe_5bps": -0.1}, False, False, "Fails statistical and cost checks"),
    ({"net_sharpe_5bps": 0.0}, False, False, "Fails cost check"),
    ({"hac_p": 0.2, "row_p": 0.3}, False, False, "Does not pass full evaluation"),
    ({"positive_quarters": 2}, False, False, "Does not pass full evaluation"),
    ({"alpha_status": "ok", "alpha_period": -0.1, "alpha_p": 0.01}, False, False, "Does not pass full evaluation"),
    ({"alpha_status": "ok", "alpha_period": 0.1, "alpha_p": 0.01}, True, True, "Passes full evaluation"),
    ({"romano_wolf_p": None}, False, False, "Does not pass full evaluation"),
])
def test_gates_and_labels(spark, changes, full, applicable, label):
    got = portfolio.status_label(portfolio.gates(gated(spark, **changes))).first()
    assert (got.passes_all, got.passes_applicable, got.status_label) == (full, applicable, label)


def test_gate_sensitivity_and_counts(spark):
    facts = gated(spark, permutation_informative=False, permutation_p=None, permutation_status="degenerate").unionByName(gated(spark, status="failed", candidate_id="d"))
    got = {(r.candidate_id, r.alpha): r for r in portfolio.gate_sensitivity(facts).collect()}
    assert not got["c", 0.05].passes_all and got["c", 0.05].passes_applicable and not got["c", 0.01].passes_applicable
    assert got["d", 0.05].passes_hac is None and not got["d", 0.05].passes_applicable and got["d", 0.05].permutation_status == "failed"
    counts = {r.alpha: tuple(r)[1:] for r in portfolio.gate_counts(portfolio.gate_sensitivity(facts)).collect()}
    assert counts == {0.05: (2, 0, 1), 0.01: (2, 0, 0)}


def date_frame(spark, values, threshold=0.5):
    rows = [("p", threshold, i, None if v is None else float(v), 1) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "panel_id string, threshold double, t_idx int, ret double, n_sel int")
    return frame.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t_idx")))


def test_nested_folds_leave_the_rest_out(spark):
    rng = np.random.default_rng(3)
    dates = date_frame(spark, rng.normal(0, 1, 107)).unionByName(date_frame(spark, rng.normal(0.5, 1, 107), 0.9))
    got = portfolio.nested_selection(dates, 252.0).orderBy("fold").collect()
    assert [r.fold for r in got] == [1, 2, 3, 4, 5] and {r.oos_n_valid for r in got} == {14}
    assert got[0].train_start == "2020-01-01" and got[0].train_end == "2020-02-04" and got[-1].test_end == "2020-04-14"
    assert len(portfolio.nested_selection(date_frame(spark, [0.1, 0.2, 0.3]), 252.0).collect()) == 2


def test_walk_forward_costs_and_own_turnover(spark):
    rng, n = np.random.default_rng(4), 100
    side = np.where(np.arange(n)[:, None] % 2 == 0, 1, -1) * np.array([1, -1])
    side[70:] = side[70]  # no turnover in the last folds
    own = long_panel(spark, side.tolist(), rng.normal(0.01, 0.02, (n, 2)).tolist(), [[1] * 2] * n)
    got = portfolio.walk_forward(own, (0.5,), 252.0, 200, 42).orderBy("fold").collect()
    assert [r.fold for r in got] == [1, 2, 3, 4, 5] and all(r.test_days == 12 for r in got) and [r.train_days for r in got] == [40, 52, 64, 76, 88]
    assert [r.daily_turnover for r in got] == pytest.approx([1.0, 1.0, 6 / 11, 0.0, 0.0])
    ret = own.groupBy("t_idx").agg(F.avg("realised").alias("r")).orderBy("t_idx").toPandas()["r"].to_numpy()
    test, train = ret[40:52], ret[:40]
    root = np.sqrt(252)
    assert got[0].is_sharpe == pytest.approx(train.mean() / train.std(ddof=1) * root) and got[0].oos_sharpe_gross == pytest.approx(test.mean() / test.std(ddof=1) * root)
    for bps, value in ((16, got[0].oos_sharpe_net_16bps), (34, got[0].oos_sharpe_net_34bps), (70, got[0].oos_sharpe_net_70bps)):
        assert value == pytest.approx((test.mean() - bps / 1e4) / test.std(ddof=1) * root)
    assert all(r.oos_ci_lo < r.oos_ci_hi and 0 < r.oos_p_value <= 1 and r.nw_se_daily > 0 for r in got)


def test_inference_record(spark):
    values = [0.01, -0.002, 0.006, 0.004, -0.001, 0.008, 0.003, -0.004, 0.007, 0.002, 0.005, 0.001]
    frame = series_frame(spark, values)
    month, day = (resample.inference(frame, resample.bootstrap(frame, "iid", 400, 3, a), a).first() for a in (12.0, 252.0))
    assert month.sharpe == pytest.approx(day.sharpe * (12 / 252) ** 0.5) and month.se < day.se and month.n_nominal == 12
    se = np.std(values, ddof=1) / np.sqrt(day.n_eff)
    tail = float(special.student_tail(np.mean(values) / se, max(1.0, day.n_eff - 1)))
    assert day.t_statistic == pytest.approx(np.mean(values) / se) and day.two_sided_p_value == pytest.approx(2 * min(tail, 1 - tail))
    short = series_frame(spark, values[:9])
    assert resample.inference(short, resample.bootstrap(short, "iid", 10, 3, 12.0), 12.0).count() == 0


def test_student_tail():
    t = np.array([0.0, 2.015048, -1.0, 1.0, 12.0, 1.959964, np.inf])
    df = np.array([5.0, 5.0, 1.0, 1.0, 2.5, 1e6, 3.0])
    want = [0.5, 0.05, 0.75, 0.25, None, 0.025, 0.0]
    for got, w in zip(special.student_tail(t, df), want, strict=True):
        assert w is None and 0 < got < 0.01 or got == pytest.approx(w, abs=1e-6)


def test_row_boundary_statuses(spark):
    rng = np.random.default_rng(31)
    common = rng.normal(0, np.sqrt(0.3), (400, 1))
    realised = common + rng.normal(0, np.sqrt(0.7), (400, 6))
    own = long_panel(spark, np.ones((400, 6)).tolist(), realised.tolist(), np.ones((400, 6)).tolist())
    got = portfolio.row_boundary(own, aggregate.date_returns(own, (0.5,)), (0.5,), 252.0).first()
    corr = np.corrcoef(realised, rowvar=False)
    assert got.status == "ok" and got.rho_same_date == pytest.approx(corr[np.triu_indices(6, 1)].mean()) and got.n_rows == 2400 and got.romano_wolf_p is None
    assert got.trading_moulton_factor == pytest.approx(np.sqrt(1 + 5 * got.rho_same_date))
    assert portfolio.same_date_correlation(own, (0.5,), block=2).first().rho_same_date == pytest.approx(got.rho_same_date)
    single = long_panel(spark, [[1]] * 20, [[0.1 * i] for i in range(20)], [[1]] * 20)
    got = portfolio.row_boundary(single, aggregate.date_returns(single, (0.5,)), (0.5,), 252.0).first()
    assert got.status == "not_applicable_single_series" and got.row_t_stat is None
    few = long_panel(spark, [[1, 1]], [[0.1, None]], [[1, 1]])
    assert portfolio.row_boundary(few, aggregate.date_returns(few, (0.5,)), (0.5,), 252.0).first().status == "insufficient_observations"


def test_mean_correlations(spark):
    rng = np.random.default_rng(7)
    values = rng.normal(0, 1, (30, 5)) + rng.normal(0, 1, (30, 1))
    values[:, 4] = 2.0
    holes = values.tolist()
    holes[3][3] = None
    own = long_panel(spark, np.ones((30, 5)).tolist(), holes, np.ones((30, 5)).tolist())
    corr = np.corrcoef(values[:, :3], rowvar=False)
    assert dependence.mean_correlation(own).first().cross_sectional_corr == pytest.approx(corr[np.triu_indices(3, 1)].mean())
    pairs = [np.corrcoef(np.delete(values[:, [i, j]], 3, axis=0) if 3 in (i, j) else values[:, [i, j]], rowvar=False)[0, 1] for i in range(4) for j in range(i + 1, 4)]
    assert dependence.pairwise_correlation(own).first().pairwise_corr == pytest.approx(np.mean(pairs))
    lonely = own.filter("e_idx = 0")
    assert dependence.mean_correlation(lonely).first().cross_sectional_corr == 0


def test_factor_alpha_against_least_squares(spark):
    rng, n = np.random.default_rng(9), 120
    x = rng.normal(0, 0.01, (n, 4))
    y = 0.002 + x @ np.array([0.5, -0.2, 0.1, 0.3]) + rng.normal(0, 0.005, n)
    dates = date_frame(spark, y)
    rows = dates.select("date").orderBy("date").collect()
    table = spark.createDataFrame([(r.date, *map(float, v), 0.0) for r, v in zip(rows, x, strict=True)][1:], "date date, mkt_rf double, smb double, hml double, mom double, rf double")
    got = factors.factor_alpha(dates, table, 252.0).first()
    full = np.column_stack([np.ones(n - 1), x[1:]])
    beta = np.linalg.solve(full.T @ full, full.T @ y[1:])
    scores = full * (y[1:] - full @ beta)[:, None]
    s = scores.T @ scores
    for k in range(1, got.hac_lag + 1):
        g = scores[k:].T @ scores[:-k]
        s += (1 - k / (got.hac_lag + 1)) * (g + g.T)
    inverse = np.linalg.inv(full.T @ full)
    assert got.n == n - 1 and got.alpha_period == pytest.approx(beta[0]) and got.alpha_se_period == pytest.approx(np.sqrt((inverse @ s @ inverse)[0, 0]))
    few = factors.factor_alpha(dates, table.limit(20), 252.0).first()
    assert few.p_positive == 1.0 and few.alpha_period is None


def test_direct_benchmark_is_half(spark):
    rows = [[0.01 + 0.002 * j * (1 + t % 3) for j in range(10)] for t in range(8)]
    returns = returns_frame(spark, rows)
    got = factors.direct_benchmark(aggregate.date_returns(panel.static_rank_panel(returns), (0.9,)), returns, 252.0).first()
    assert got.n == 7 and got.sharpe_abs_diff < 1e-9 and got.median_scale == pytest.approx(0.5)


def test_permutations(spark):
    rng = np.random.default_rng(5)
    own = long_panel(spark, rng.normal(0, 1, (40, 4)).tolist(), rng.normal(0, 1, (40, 4)).tolist(), rng.random((40, 4)).tolist())
    draws = resample.permuted_sharpe(own, (0.0, 0.5), 5, 7, 252.0, F.expr("e_idx div 2"))
    assert draws.count() == 10
    entities = F.lit(4).alias("entities")
    observed = aggregate.threshold_sharpe(aggregate.date_returns(own, (0.0, 0.5)), 252.0).select("panel_id", "threshold", F.col("sharpe").alias("observed_sharpe"), entities)
    assert {r.status for r in resample.null_summary(draws, observed).collect()} == {"ok"}
    single = observed.withColumn("entities", F.lit(1))
    assert {(r.status, r.n_perms, r.p_positive) for r in resample.null_summary(draws, single).collect()} == {("not_applicable_single_series", 0, None)}
    none = resample.null_summary(draws.filter("threshold < 0"), observed).first()
    assert none.status == "insufficient_permutation_draws" and none.p_positive is None
    held = long_panel(spark, [[1] * 3] * 40, rng.normal(0, 1, (40, 3)).tolist(), [[1] * 3] * 40)
    same = resample.permuted_sharpe(held, (0.5,), 10, 7, 252.0)
    seen = aggregate.threshold_sharpe(aggregate.date_returns(held, (0.5,)), 252.0).select("panel_id", "threshold", F.col("sharpe").alias("observed_sharpe"), entities)
    assert resample.null_summary(same, seen).first().status == "degenerate"
    assert {round(r.sharpe, 9) for r in same.collect()} == {round(seen.first().observed_sharpe, 9)}


def test_fixed_b_and_stationarity(spark):
    rng = np.random.default_rng(22)
    frame = series_frame(spark, rng.normal(0.01, 0.02, 180))
    got = robustness.fixed_b(frame, 252.0, (0.05, 0.1), 25, 120).orderBy("b").collect()
    assert [(r.bandwidth, r.simulation_length, r.simulation_bandwidth, r.n_sim) for r in got] == [(9, 120, 6, 25), (18, 120, 12, 25)]
    assert all(0 < r.fixedb_positive_p <= 1 and r.fixedb_abs_crit_95 > 0 for r in got)
    noise, walk = rng.normal(0, 1, 300), np.cumsum(rng.normal(0, 1, 300))
    still, moving = (robustness.stationarity(series_frame(spark, x), 252.0).first() for x in (noise, walk))
    assert still.adf_p < 0.01 and still.kpss_p > 0.05 and moving.adf_p > 0.05 and moving.kpss_p < 0.05
    assert robustness.stationarity(series_frame(spark, noise[:20]), 252.0).first().adf_p is None


def test_menu_below_ten_dates_gives_ones(spark):
    got = resample.romano_wolf(date_frame(spark, [0.1, 0.2, 0.3]), 20, 1).first()
    assert (got.t_stat, got.p_raw, got.p_adjusted, got.block_size) == (0.0, 1.0, 1.0, None)


def test_order_size_bound(spark):
    facts = spark.createDataFrame([(0.01, 0.1, 400, 1.0, 0.5), (0.001, 0.1, 400, 2.0, 0.5), (0.01, 0.1, 400, 1.0, 0.0)], "mean double, sd double, n int, moulton double, daily_turnover double")
    got = [r.order_size for r in portfolio.order_size_bound(facts, 1000.0, 0.1, 1.0).collect()]
    assert got[0] == pytest.approx(1000 * ((0.01 - 0.005) / 0.05) ** 2) and got[1] == 0 and got[2] is None


def test_labels_and_booleans(spark):
    frame = spark.createDataFrame([("OK", "True"), ("degenerate", " n "), ("other", "?"), (None, None)], "s string, b string")
    rows = frame.select(reports.status_shown(F.col("s")), reports.lenient_boolean(F.col("b"), True), reports.permutation_p_shown(F.col("s"), F.lit(0.5)), reports.labelled(F.col("s"), {"OK": "yes"})).collect()
    assert [tuple(r) for r in rows] == [("Available", True, "0.5000", "yes"), ("Permutation null degenerate", False, "N/A", "degenerate"), ("other", True, "0.5000", "other"), ("", True, "0.5000", None)]


def test_report_projections(spark):
    rates = spark.createDataFrame([("a", "hac", 0.9), ("a", "iid", 0.8), ("b", "hac", 0.7)], "dgp string, method string, coverage double")
    assert {tuple(r) for r in reports.rates_wide(rates, "dgp", "method", "coverage", ["hac", "iid"]).collect()} == {("a", 0.9, 0.8), ("b", 0.7, None)}
    sweep = spark.createDataFrame([("rho=0.5, N=50", "hac", 0.05, 0.6), ("N=5, rho=0.35", "hac", 0.06, 0.6), ("x", "hac", 0.0, 0.0)], "design string, method string, rejection double, mean_se double")
    assert sorted(r.panel for r in reports.design_panels(sweep).collect()) == ["A", "B"]
    menu = spark.createDataFrame([("c", 0.25, 1), ("c", 0.75, 2), ("d", 0.9, 3)], "candidate_id string, threshold double, x int")
    assert {(r.candidate_id, r.x) for r in reports.primary_rows(menu, 0.5).collect()} == {("c", 1), ("d", 3)}
    windows = spark.createDataFrame([("c", f"quarter_{i}", s, i) for i, s in ((1, 0.5), (2, -0.1), (3, 0.5), (4, 0.2))] + [("c", "train_70pct", 1.0, 9)], "candidate_id string, window string, sharpe double, n int")
    assert {(r.window, r.sharpe, r.n) for r in reports.holdout(windows).collect()} == {("train_70pct", 1.0, 9), ("quarter_min", -0.1, 2), ("quarter_max", 0.5, 1)}
    kinds = spark.createDataFrame([("c", "panel"), ("d", "single_series_factor")], "candidate_id string, candidate_type string")
    costs = spark.createDataFrame([(x, 5, 0.1, 1.0, 0.9, 30.0) for x in "cd"], "candidate_id string, cost_bps_per_rebalance int, daily_turnover double, gross_sharpe double, net_sharpe double, break_even_cost_bps double")
    assert [r.candidate_id for r in reports.costs(costs, kinds).collect()] == ["c"]


def test_checks_find_what_breaks_them(spark):
    frame = spark.createDataFrame([(1.0, 0.5, 10), (float("inf"), None, 20)], "a double, b double, n int")
    assert {r.rule for r in validation.not_finite(frame, "t").collect()} == {"infinite a", "missing b"}
    assert {r.rule for r in validation.not_finite(frame, "t", ("b",)).collect()} == {"infinite a"}
    assert [r.rule for r in validation.not_finite(frame.limit(0), "t").collect()] == ["empty"]
    menu = spark.createDataFrame([(0.1, 0.2), (0.3, 0.2)], "p_raw double, p_adjusted double")
    assert validation.adjusted_below_raw(menu).count() == 1
    assert validation.below_scale(frame, "t", "n", 15).count() == 1
    files = spark.createDataFrame([("x", 0, "ab"), ("y", 5, "c" * 64)], "path string, bytes long, sha256 string")
    assert {r.rule for r in validation.bad_provenance(files).collect()} == {"empty file", "no sha256"}
    bench = spark.createDataFrame([(0.0, 0.5), (1e-3, 0.4)], "sharpe_abs_diff double, median_scale double")
    assert validation.benchmark_off(bench).count() == 2
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert [r.detail for r in validation.missing_keys(keys, keys.filter("k = 'a'"), "t").collect()] == ['{"k":"b"}']
    assert validation.shared_keys(keys, keys.filter("k = 'a'")).count() == 1
