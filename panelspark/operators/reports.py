"""Report projections: each a small query over result tables, which have a candidate_id.

ATTEMPTS  candidate_id, status, gross_sharpe, hac_p, romano_wolf_p, permutation_p, permutation_status
GATES     candidate_id, alpha, bootstrap_p, net_sharpe_5bps, permutation_status, passes_all, passes_applicable ..
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The texts that statuses are shown as.
STATUS_LABELS = {
    "ok": "Available",
    "degenerate": "Permutation null degenerate",
    "not_applicable_single_series": "Not applicable",
    "insufficient_permutation_draws": "Insufficient permutation draws",
    "failed": "Source not loaded",
    "phantom": "Fails permutation check",
    "robust": "Passes full rule",
    "cost fail": "Fails cost check",
    "not robust": "Fails full rule",
    "not available": "Unavailable",
}
WITHOUT_P = ("degenerate", "not_applicable_single_series", "insufficient_permutation_draws")


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, by a map; other values stay."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value) if pairs else value


def status_shown(status: Column) -> Column:
    """The text of a status, whatever its case; null is empty."""
    return F.when(status.isNull(), "").otherwise(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in STATUS_LABELS.items() for x in pair)), F.lower(status)), status))


def permutation_p_shown(status: Column, p: Column, digits: int = 4) -> Column:
    """N/A where the status has no p-value, else the value as text."""
    return F.when(F.lower(status).isin(*WITHOUT_P), "N/A").otherwise(F.format_string(f"%.{digits}f", p))


def lenient_boolean(value: Column, default: bool = False) -> Column:
    """true, 1, yes and y are true, false, 0, no and n false, whatever their case; all else is the default."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y"), True).when(text.isin("false", "0", "no", "n"), False).otherwise(default)


def primary_rows(menu: DataFrame, primary: float) -> DataFrame:
    """Of each candidate's menu, the row whose threshold is nearest to ``primary`` (the first of equal ones)."""
    row = F.struct(*menu.columns)
    return menu.groupBy("candidate_id").agg(F.min_by(row, F.struct(F.abs(F.col("threshold") - primary), "threshold")).alias("row")).select("row.*")


def candidates(attempts: DataFrame, gates: DataFrame, kinds: tuple[str, ...] | None = None, alpha: float = 0.05) -> DataFrame:
    """The candidates that loaded (of these ``kinds``) with their gate at one level; what has none passes nothing."""
    own = attempts.filter(F.col("status") == "ok")
    own = own if kinds is None else own.filter(F.col("candidate_type").isin(*kinds))
    own = own.select("candidate_id", "status", "gross_sharpe", "hac_p", "romano_wolf_p", "permutation_p", "permutation_status")
    gate = gates.filter(F.col("alpha") == alpha).groupBy("candidate_id").agg(
        *(F.first(c).alias(c) for c in ("bootstrap_p", "net_sharpe_5bps", "passes_all", "passes_applicable")), F.first("permutation_status").alias("gate_status")
    )
    rows = own.join(gate, "candidate_id", "left")
    return rows.select(
        "candidate_id", status_shown(F.col("status")).alias("status"), "gross_sharpe", "hac_p", "bootstrap_p", "romano_wolf_p",
        permutation_p_shown(F.coalesce("gate_status", "permutation_status"), F.col("permutation_p")).alias("permutation_p"), "net_sharpe_5bps",
        lenient_boolean(F.col("passes_all")).alias("full_rule"), lenient_boolean(F.col("passes_applicable")).alias("applicable_checks"),
    )


def panel_status(panels: DataFrame, audits: DataFrame) -> DataFrame:
    """The panel candidates with the status text of their evaluation; empty where there is none."""
    return panels.join(audits.select("candidate_id", "status_label"), "candidate_id", "left").withColumn("status_label", F.coalesce("status_label", F.lit("")))


def comparator(boundary: DataFrame, methods: DataFrame) -> DataFrame:
    """Pooled-row against date-level p-values, and the floored variance inflation."""
    p = lambda m: F.max(F.when(F.col("method") == m, F.col("p_positive")))
    by_method = methods.groupBy("candidate_id").agg(p("iid").alias("date_iid_p"), p("moving_block").alias("moving_block_p"))
    sei = F.col("trading_moulton_factor")
    return boundary.filter("status = 'ok'").join(by_method, "candidate_id", "left").select(
        "candidate_id", F.col("row_p_positive").alias("row_naive_p"), "date_iid_p", F.col("hac_p_positive").alias("date_hac_p"), "moving_block_p",
        F.when(sei.isNotNull(), F.greatest(F.lit(1.0), sei * sei)).alias("uvif"),
    )


def inference_long(methods: DataFrame, hac: DataFrame, prewhite: DataFrame) -> DataFrame:
    """Block bootstrap, HAC and prewhitened HAC of each candidate, a row each."""
    own = lambda frame, name, p: frame.select("candidate_id", F.lit(name).alias("method"), "sharpe", "se", "ci_lo", "ci_hi", F.col(p).alias("p_positive"), "n")
    rows = own(methods.filter("method = 'moving_block'"), "block", "p_positive").unionByName(own(hac, "HAC", "positive_p_value"))
    return rows.unionByName(own(prewhite, "prewhite", "positive_p_value"))


def permutations(summary: DataFrame) -> DataFrame:
    """The permutation nulls that ran."""
    return summary.filter(F.lower("status").isin("ok", "degenerate")).select(
        "candidate_id", "threshold", "observed_sharpe", "null_mean", "null_sd", permutation_p_shown(F.col("status"), F.col("p_positive")).alias("p_positive"),
        status_shown(F.col("status")).alias("status"), "n_perms",
    )


def boundary_counts(boundary: DataFrame) -> DataFrame:
    """The counting half of the row boundary."""
    return boundary.select("candidate_id", status_shown(F.col("status")).alias("status"), "threshold", "n_rows", "n_dates", "avg_names", "rho_same_date", "trading_moulton_factor")


def boundary_p_values(boundary: DataFrame) -> DataFrame:
    """The p-values of the row boundary."""
    return boundary.select("candidate_id", "threshold", "row_t_stat", "date_hac_z", "row_p_positive", "hac_p_positive", "romano_wolf_p")


def robustness(sweep: DataFrame, prewhite: DataFrame, fixed: DataFrame, labels: tuple[str, ...] = ("auto", "21", "63"), share: float = 0.1) -> DataFrame:
    """The HAC rows of some bandwidths, the prewhitened one, and fixed-b at one share."""
    own = lambda frame, name, p: frame.select("candidate_id", name.alias("diagnostic"), "sharpe", "se", F.col(p).alias("p_positive"))
    rows = own(sweep.filter(F.col("lag_label").isin(*labels)), F.concat(F.lit("HAC K="), F.col("lag_label")), "positive_p_value")
    rows = rows.unionByName(own(prewhite, F.lit("prewhite"), "positive_p_value"))
    return rows.unionByName(own(fixed.filter(F.abs(F.col("b") - share) < 1e-9), F.concat(F.lit("fixed-b "), F.col("b").cast("string")), "fixedb_positive_p"))


def holdout(windows: DataFrame) -> DataFrame:
    """Training, holdout, and the worst and the best quarter of each candidate."""
    kept = windows.filter(F.col("window").isin("train_70pct", "holdout_30pct")).select("candidate_id", "window", "sharpe", "n")
    quarters = windows.filter(F.col("window").startswith("quarter_"))
    row = F.struct("sharpe", "n")
    ends = quarters.groupBy("candidate_id").agg(
        F.min_by(row, F.struct("sharpe", "window")).alias("quarter_min"), F.max_by(row, F.struct(F.col("sharpe"), -F.substring("window", 9, 1).cast("int"))).alias("quarter_max")
    )
    for name in ("quarter_min", "quarter_max"):
        kept = kept.unionByName(ends.select("candidate_id", F.lit(name).alias("window"), F.col(f"{name}.sharpe").alias("sharpe"), F.col(f"{name}.n").alias("n")))
    return kept


def costs(sensitivity: DataFrame, kinds: DataFrame) -> DataFrame:
    """Costs of all candidates that aren't single series."""
    own = kinds.filter("candidate_type <> 'single_series_factor'").select("candidate_id")
    return sensitivity.join(own, "candidate_id", "left_semi").select("candidate_id", "cost_bps_per_rebalance", "daily_turnover", "gross_sharpe", "net_sharpe", "break_even_cost_bps")


def thresholds_wide(menu: DataFrame) -> DataFrame:
    """p_adjusted by correction, a column each: ``menu`` has candidate_id, threshold, sharpe, p_raw, n_eff, avg_names, correction and p_adjusted."""
    keys = ("candidate_id", "threshold", "sharpe", "p_raw", "n_eff", "avg_names")
    wide = menu.groupBy(*keys).pivot("correction", ["holm", "romano_wolf", "by", "storey"]).agg(F.first("p_adjusted"))
    return wide.select(*keys, F.col("holm").alias("p_holm"), F.col("romano_wolf").alias("p_romano_wolf"), F.col("by").alias("p_by"), F.col("storey").alias("q_storey"))


def rates_wide(rates: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A pivot of Monte Carlo rates, the mean of each cell: coverage, size and power tables."""
    return rates.groupBy(row).pivot(column, columns).agg(F.avg(value))


def design_panels(sweep: DataFrame) -> DataFrame:
    """The design sweep's two panels: by correlation at one width (A), by width at one correlation (B)."""
    panel = F.when(F.col("design").startswith("rho="), "A").when(F.col("design").startswith("N="), "B")
    return sweep.select(panel.alias("panel"), "design", "method", "rejection", "mean_se").filter("panel is not null")


def horizons(effects: DataFrame) -> DataFrame:
    """The effect of the lookback: ``effects`` has lookback, threshold, n_dates, avg_names, gross_sharpe, net_sharpe_5bps, daily_turnover, uvif_sr and serial_uvif_sr."""
    return effects.orderBy("lookback").select(
        F.col("lookback").cast("string").alias("lookback"), "threshold", F.col("n_dates").cast("string").alias("n_dates"), "avg_names", "gross_sharpe", "net_sharpe_5bps",
        "daily_turnover", "uvif_sr", "serial_uvif_sr", "hac_p",
    )
