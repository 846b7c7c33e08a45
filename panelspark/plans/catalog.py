"""The panel engine's registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.plans import panel_queries as q
from panelspark.plans import panel_sql

PLAIN = (
    q.threshold_sharpe, q.threshold_sharpe_monthly, q.threshold_sharpe_daily, q.dense_returns, q.tail_returns, q.strategy_panel, q.static_rank_panel,
    q.constant_long_panel, q.weighted_date_returns, q.selected_counts, q.autocorrelation, q.effective_size, q.hac_sharpe, q.bandwidth_sweep,
    q.sharpe_effective_size, q.block_lengths, q.rolling_sharpe, q.bootstrap_summary, q.entity_bootstrap, q.romano_wolf, q.white_reality_check,
    q.corrections, q.deflated_sharpe, q.permutation_draws, q.grouped_permutation, q.signal_permutation, q.placebo, q.turnover, q.turnover_neutral,
    q.cost_sensitivity, q.holdout_windows, q.nested_selection, q.walk_forward, q.capacity, q.row_boundary, q.row_naive, q.candidate_gates,
    q.gate_sensitivity, q.gate_counts, q.inference_methods, q.menu_table, q.dependence_summary, q.pairwise_correlation, q.variance_inflation,
    q.fixed_b, q.stationarity, q.order_size, q.direct_benchmark, q.block_returns, q.price_returns, q.price_notes, q.factor_series, q.factor_table,
    q.aligned_factors, q.factor_alpha, q.prewhitened_hac, q.sharpe_inflation, q.report_holdout, q.report_costs, q.report_inference,
    q.report_robustness, q.report_comparator, q.report_boundary, q.report_candidates, q.report_status, q.report_permutations, q.report_thresholds,
    q.report_horizons, q.head_returns, q.active_span, q.result_violations, q.shared_months, q.unfinished_work, q.uniform_counter,
    q.streamed_sharpe_daily, q.streamed_turnover_daily, q.streamed_sessions, q.piece_returns,
    q.archive_returns, q.workbook_series, q.report_fixed_b,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> function of (spark, sf_dir)."""
    found = {f.__name__: f for f in PLAIN}
    return found | {f"bootstrap_{m}": q.bootstrap_draws(m) for m in ("iid", "moving_block", "stationary")}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return panel_sql.oracle()
