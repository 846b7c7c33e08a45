"""Small panels with hand-computed results, invariants, and plan checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import special
from panelspark.operators import aggregate, panel, portfolio, resample, series


def long_panel(spark, pred, realised, conf):
    rows = [
        ("p", t, e, e, *(m[t][e] if m[t][e] is None else float(m[t][e]) for m in (pred, realised, conf)))
        for t in range(len(pred))
        for e in range(len(pred[0]))
    ]
    frame = spark.createDataFrame(rows, "panel_id string, t_idx int, e_idx int, entity int, pred double, realised double, conf double")
    return frame.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t_idx")))


def returns_frame(spark, matrix):
    nothing = [[0.0] * len(matrix[0])] * len(matrix)
    return long_panel(spark, nothing, matrix, nothing).select(*panel.IDS, F.col("realised").alias("ret"))


def by_date(frame, column="ret"):
    return [r[column] for r in frame.orderBy("threshold", "t_idx").collect()]


def series_frame(spark, values):
    return spark.createDataFrame([("p", 0.5, i, float(v)) for i, v in enumerate(values)], "panel_id string, threshold double, u int, r double")


def test_skipped_signal(spark):
    ret = returns_frame(spark, [[0.1, 0.01], [0.2, 0.02], [0.3, 0.03], [0.4, 0.04], [0.5, 0.05]])
    got = {(r.t_idx, r.e_idx): r.s for r in ret.withColumn("s", panel.compounded(F.col("ret"), 2, 1)).collect()}
    assert got[2, 0] == pytest.approx(1.1 * 1.2 - 1) and got[4, 1] == pytest.approx(1.03 * 1.04 - 1)
    assert got[0, 0] is None and got[1, 0] is None
    with pytest.raises(ValueError):
        panel.compounded(F.col("ret"), 0, 1)


def test_sign_and_midranks(spark):
    frame = spark.createDataFrame([(-2.0,), (0.0,), (3.0,), (None,)], "x double")
    assert [r[0] for r in frame.select(special.sign(F.col("x"))).collect()] == [-1, 0, 1, 0]
    scores = long_panel(spark, [[1, 2, 2, None], [None, 5, None, None], [3, 3, None, None]], [[0] * 4] * 3, [[0] * 4] * 3)
    got = [r.c for r in scores.withColumn("c", panel.rank_confidence(F.col("pred"))).orderBy("t_idx", "e_idx").collect()]
    assert got == [0, 0.75, 0.75, None, None, 1, None, None, 0.5, 0.5, None, None]


def test_weighting_and_neutrality(spark):
    own = long_panel(spark, [[1, 2], [1, -1]], [[0.01, 0.03], [0.02, -0.01]], [[0.5, 1], [0.5, 0.9]])
    assert by_date(aggregate.date_returns(own, (0.0,))) == pytest.approx([0.02, 0.005])
    assert by_date(aggregate.date_returns(own, (0.0,), "confidence"))[0] == pytest.approx((0.01 * 0.5 + 0.03) / 1.5)
    assert by_date(aggregate.date_returns(own, (0.0,), "signal_abs"))[0] == pytest.approx(0.07 / 3)
    own = long_panel(spark, [[1, -1, 1], [1, 1, 1]], [[0.02, 0.04, 0.06], [0.01, 0.03, 0.05]], [[1] * 3] * 2)
    got = by_date(aggregate.date_returns(own, (0.0,), exposure="dollar_neutral"))
    assert got[0] == pytest.approx(0.04) and got[1] is None
    first = [r.weight for r in aggregate.target_weights(own, (0.0,), "dollar_neutral").filter("t_idx = 0").collect()]
    assert sum(w for w in first if w > 0) == pytest.approx(0.5) and sum(w for w in first if w < 0) == pytest.approx(-0.5)


def test_counts(spark):
    own = long_panel(spark, [[1] * 3] * 2, [[0.1] * 3] * 2, [[0.2, 0.5, 0.9], [0.1, None, 0.95]])
    assert by_date(aggregate.selected_counts(own, (0.5, 0.9)), "n") == [2, 1, 1, 1]


def test_static_ranks(spark):
    rows = [[0.01 + 0.001 * j for j in range(10)] for _ in range(5)]
    own = panel.static_rank_panel(returns_frame(spark, rows))
    assert by_date(aggregate.selected_counts(own, (0.7,)), "n") == [4, 4, 4, 4, 0]
    conf = sorted(round(r.conf, 4) for r in own.filter("t_idx = 0").collect())
    assert conf == [0.0556] * 2 + [0.2778] * 2 + [0.5] * 2 + [0.7222] * 2 + [0.9444] * 2


def test_turnover(spark):
    own = long_panel(spark, [[1, -1], [1, -1], [-1, 1]], [[0.1] * 2] * 3, [[1] * 2] * 3)
    assert portfolio.turnover(own, (0.5,)).first().daily_turnover == pytest.approx(0.5)
    own = long_panel(spark, [[1, -1, 0], [1, -1, 1]], [[0.1, 0.1, None], [0.1] * 3], [[1, 1, None], [1] * 3])
    got = portfolio.turnover(own, (0.5,)).first()
    assert (got.daily_turnover, got.turnover_rescale, got.turnover_entry_exit_flip) == pytest.approx((1 / 3, 1 / 6, 1 / 6))


def test_corrections(spark):
    p = spark.createDataFrame([("p", 0.1, 0.01), ("p", 0.2, 0.02), ("p", 0.3, 0.20)], "panel_id string, threshold double, p double")
    got = resample.corrections(p).orderBy("p").collect()
    assert [r.p_holm for r in got] == pytest.approx([0.03, 0.04, 0.20])
    assert [r.p_bh for r in got] == pytest.approx([0.03, 0.03, 0.20])
    assert [r.p_by for r in got] == pytest.approx([min(1, x * (1 + 1 / 2 + 1 / 3)) for x in (0.03, 0.03, 0.20)])


def test_hac_against_numpy(spark):
    rng = np.random.default_rng(11)
    r = rng.normal(0.001, 0.02, 300)
    got = series.hac_sharpe(series_frame(spark, r), 252.0, lag=5).first()
    z = np.column_stack([r, r * r])
    z = z - z.mean(axis=0)
    s = z.T @ z / len(r)
    for k in range(1, 6):
        g = z[:-k].T @ z[k:] / len(r)
        s += (1 - k / 6) * (g + g.T)
    mu, m2 = r.mean(), (r * r).mean()
    v = m2 - mu * mu
    d = np.sqrt(252) * np.array([m2 / v**1.5, -0.5 * mu / v**1.5])
    assert got.sharpe == pytest.approx(np.sqrt(252) * mu / np.sqrt(v))
    assert got.se == pytest.approx(np.sqrt(d @ s @ d / len(r)))
    assert 0 <= got.positive_p_value <= 1


def test_dependence_lowers_the_effective_size(spark):
    rng, x = np.random.default_rng(4), [0.0]
    for _ in range(999):
        x.append(0.65 * x[-1] + rng.normal())
    frame = series_frame(spark, x)
    got = series.sharpe_effective_size(frame, 252.0).first()
    assert got.se_hac_delta > got.se_iid_delta and got.n_eff_sr < 1000
    assert series.effective_size(frame).first().n_eff < 1000
    assert series.block_lengths(frame).first().block_size > 4


def test_bootstraps_agree_and_ignore_partitioning(spark):
    rng = np.random.default_rng(5)
    frame = series_frame(spark, rng.normal(0.1, 1, 60))
    one = resample.bootstrap(frame, "stationary", 20, 7, 252.0).orderBy("draw").collect()
    two = resample.bootstrap(frame.repartition(5), "stationary", 20, 7, 252.0).orderBy("draw").collect()
    assert [r.sharpe for r in one] == pytest.approx([r.sharpe for r in two])


def test_drawn_places_follow_the_methods():
    draws = np.arange(300)
    block = resample.drawn_places("moving_block", 50, 7, draws, 3)
    assert block.shape == (300, 50) and block.min() >= 0 and block.max() <= 49
    steps = np.diff(block, axis=1)
    assert (np.delete(steps, np.arange(6, 49, 7), axis=1) == 1).all()
    runs = resample.drawn_places("stationary", 50, 7, draws, 3)
    share = ((np.diff(runs, axis=1) % 50) == 1).mean()
    assert abs(share - 6 / 7) < 0.03
    assert (resample.drawn_places("iid", 50, 7, draws, 3) == resample.drawn_places("cluster_date", 50, 1, draws, 3)).all()
    with pytest.raises(ValueError):
        resample.drawn_places("other", 50, 7, draws, 3)


def test_degenerate_null_gives_no_p(spark):
    draws = spark.createDataFrame([("p", 0.5, i, 1.0) for i in range(20)], "panel_id string, threshold double, perm int, sharpe double")
    observed = spark.createDataFrame([("p", 0.5, 1.0, 3)], "panel_id string, threshold double, observed_sharpe double, entities int")
    got = resample.null_summary(draws, observed).first()
    assert got.status == "degenerate" and got.p_positive is None and not got.permutation_informative


def test_adjusted_not_below_raw(spark):
    rng = np.random.default_rng(2)
    rows = [("p", t / 10, d, float(rng.normal(0.1, 1)), 1) for t in range(3) for d in range(80)]
    dates = spark.createDataFrame(rows, "panel_id string, threshold double, t_idx int, ret double, n_sel int")
    assert all(r.p_adjusted >= r.p_raw for r in resample.romano_wolf(dates, 50, 3).collect())


def test_special_functions(spark):
    frame = spark.createDataFrame([(z / 4,) for z in range(-16, 17)], "z double")
    for r in frame.select("z", special.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=2e-7)


def test_signals_and_date_returns_share_exchanges(spark):
    """Along time once, across entities once for ranks and ties, and the date's aggregate; no cross joins."""
    values = spark.createDataFrame([("p", d, e, float(1 + d + e)) for d in range(8) for e in range(4)], "panel_id string, date int, entity int, value double")
    dates = aggregate.date_returns(panel.momentum_panel(panel.returns_of(values), 2, 0), (0.0, 0.5))
    plan = dates._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert dates.count() == 16
    own = returns_frame(spark, [[0.1, 0.2]] * 6)
    plan = panel.momentum_panel(own, 2, 0)._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len([x for x in keyed if "e_idx" in x.split("hashpartitioning(")[1].split(")")[0]]) == 1
