"""The panel engine's queries over the warehouse tables, as Spark plans.

All run on whole tables. Results are rounded where they depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.special import counter
from panelspark.operators import aggregate, campaign, dependence, factors, panel, portfolio, reports, resample, robustness, series, validation
from panelspark.sources import archives, panels, pieces, storage, store, texts, workbooks
from panelspark.streaming import events, jobs
from panelspark.tables import new_dir, written

THRESHOLDS = (0.0, 0.3, 0.5, 0.7, 0.9)
WEEKS, MONTHS, DAYS = 52.0, 12.0, 252.0
LOOKBACK, SKIP = 4, 1
SEED, DRAWS, PERMS = 42, 5000, 1000
PRIMARY = 0.5


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; the panel's id dropped where it is the only one; counts as long."""
    def of(name: str, kind: str) -> Column:
        if kind == "double":
            return F.round(F.col(name), digits).alias(name)
        return F.col(name).cast("long").alias(name) if kind in ("int", "bigint") else F.col(name)

    return frame.select(*(of(c, k) for c, k in frame.dtypes if c != "panel_id"))


def ship_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RETURNS of the weekly shipment panel."""
    return panel.returns_of(panels.ship_week(spark, sf_dir))


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PANEL of the weekly shipment momentum."""
    return panel.momentum_panel(ship_returns(spark, sf_dir), LOOKBACK, SKIP)


def kept_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once for queries that read it several times."""
    return written(ship_panel(spark, sf_dir), "panel")


def ship_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE_RETURNS of the weekly shipment momentum, written once: a row for each date and threshold."""
    return written(aggregate.date_returns(ship_panel(spark, sf_dir), THRESHOLDS), "dates")


def ship_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SERIES of the weekly shipment momentum, written once."""
    return written(aggregate.series_of(aggregate.date_returns(ship_panel(spark, sf_dir), THRESHOLDS)), "series")


def with_id(frame: DataFrame) -> DataFrame:
    """The panel's id as a candidate's."""
    return frame.withColumnRenamed("panel_id", "candidate_id")


def threshold_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio by threshold of the weekly shipment momentum."""
    return rounded(aggregate.threshold_sharpe(aggregate.date_returns(ship_panel(spark, sf_dir), THRESHOLDS), WEEKS))


def threshold_sharpe_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio by threshold of the monthly order momentum."""
    own = panel.momentum_panel(panel.returns_of(panels.order_month(spark, sf_dir)), 3, 1)
    return rounded(aggregate.threshold_sharpe(aggregate.date_returns(own, THRESHOLDS), MONTHS))


def threshold_sharpe_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio by threshold of the daily event momentum."""
    own = panel.momentum_panel(panel.returns_of(panels.event_day(spark, sf_dir)), 2, 0)
    return rounded(aggregate.threshold_sharpe(aggregate.date_returns(own, THRESHOLDS), DAYS))


#: Later than all events: what closes a bounded stream.
CLOSING = "2100-01-01 00:00:00"


def streamed_sharpe_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all events as a stream: closed days, date returns and running summaries, each from the table before."""
    found = jobs.replay(spark, f"{sf_dir}/events.parquet*", new_dir(spark, "stream"), THRESHOLDS, 2, 0, DAYS, CLOSING)
    return rounded(found.select("panel_id", "threshold", "n_dates", "avg_names", "mean", "sd", "sharpe"))


def streamed_turnover_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turnover and its parts of all events as a stream, from the running summaries."""
    found = jobs.replay(spark, f"{sf_dir}/events.parquet*", new_dir(spark, "stream"), THRESHOLDS, 2, 0, DAYS, CLOSING)
    return rounded(found.select("panel_id", "threshold", "daily_turnover", "turnover_rescale", "turnover_entry_exit_flip", "n_turnover_pairs"))


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the users' events as a stream: how many, how long and what they sum to."""
    work_dir = new_dir(spark, "stream")
    events.heartbeat(spark, f"{work_dir}/heartbeat", CLOSING)
    jobs.close_sessions(spark, f"{sf_dir}/events.parquet*", work_dir, gap="6 hours", beats=f"{work_dir}/heartbeat")
    found = spark.read.parquet(f"{work_dir}/sessions")
    length = F.timestamp_diff("MINUTE", "first", "last")
    return rounded(found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max(length).alias("longest_minutes"), panels.exact_sum(F.col("value")).alias("value")), 4)


def dense_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple returns on the dense calendar."""
    return rounded(ship_returns(spark, sf_dir).select("panel_id", "t_idx", "e_idx", "ret"))


def tail_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 dates of the returns."""
    return rounded(panel.last_dates(ship_returns(spark, sf_dir), 20).select("panel_id", "t_idx", "e_idx", "ret"))


def strategy_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal, realised return and rank confidence of every cell."""
    return rounded(ship_panel(spark, sf_dir).select("panel_id", "t_idx", "e_idx", "pred", "realised", "conf"))


def static_rank_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date returns of the static ranking, dollar neutral."""
    own = panel.static_rank_panel(ship_returns(spark, sf_dir))
    dates = aggregate.date_returns(own, (0.5, 0.9), exposure="dollar_neutral")
    return rounded(dates.select("panel_id", "threshold", "t_idx", "ret"))


def constant_long_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date returns of holding everything."""
    dates = aggregate.date_returns(panel.constant_long_panel(ship_returns(spark, sf_dir)), (0.5,))
    return rounded(dates.select("panel_id", "t_idx", "ret", "n_sel"))


def weighted_date_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date returns by weighting and exposure at one threshold."""
    own, out = kept_panel(spark, sf_dir), None
    for name, exposure in (("equal", "as_selected"), ("confidence", "as_selected"), ("signal_abs", "as_selected"), ("equal", "dollar_neutral")):
        dates = aggregate.date_returns(own, (0.5,), name, exposure).select("panel_id", F.lit(name).alias("weighting"), F.lit(exposure).alias("exposure"), "t_idx", "ret")
        out = dates if out is None else out.unionByName(dates)
    return rounded(out)


def selected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names each threshold selects."""
    return rounded(aggregate.count_summary(aggregate.selected_counts(ship_panel(spark, sf_dir), THRESHOLDS)))


def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelations up to lag 20 by threshold."""
    return rounded(series.autocorrelation(ship_series(spark, sf_dir)).select("panel_id", "threshold", "k", "rho"))


def effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective sample sizes by autocorrelation."""
    return rounded(series.effective_size(ship_series(spark, sf_dir)), 4)


def hac_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAC delta-method inference by threshold."""
    return rounded(series.hac_sharpe(ship_series(spark, sf_dir), WEEKS), 5)


def bandwidth_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAC inference by bandwidth."""
    return rounded(series.bandwidth_sweep(ship_series(spark, sf_dir), WEEKS).drop("requested_lag"), 5)


def prewhitened_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prewhitened HAC inference by threshold."""
    found = robustness.prewhitened_hac(ship_series(spark, sf_dir), WEEKS)
    return rounded(found.select("panel_id", "threshold", "n", "sharpe", "se", "z_statistic", "positive_p_value", "bandwidth"), 4)


def sharpe_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HAC variance of the Sharpe ratio over that of pooled rows taken as independent."""
    rows = ship_panel(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    place = F.col("t_idx").cast("long") * (1 << 31) + F.col("e_idx")
    rows = rows.filter((F.col("conf") >= F.col("threshold")) & F.col("realised").isNotNull() & F.col("pred").isNotNull())
    found = robustness.sharpe_inflation(ship_series(spark, sf_dir), rows.select("panel_id", "threshold", place.alias("u"), F.col("realised").alias("r")), WEEKS)
    return rounded(found.withColumn("uvif_sr", F.round("uvif_sr", 4)), 5)


def sharpe_effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe-specific effective sample sizes."""
    return rounded(series.sharpe_effective_size(ship_series(spark, sf_dir), WEEKS), 4)


def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block lengths for resampling."""
    return rounded(series.block_lengths(ship_series(spark, sf_dir)))


def rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of the rolling Sharpe ratio."""
    return rounded(series.rolling_sharpe(ship_series(spark, sf_dir), WEEKS), 4)


def bootstrap_draws(method: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query for the draws of one bootstrap."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(resample.bootstrap(ship_series(spark, sf_dir), method, DRAWS, SEED, WEEKS), 5)

    run.__doc__ = f"Sharpe ratios of {method} bootstrap draws."
    return run


def bootstrap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, interval and p-value of the block bootstrap."""
    return rounded(resample.draw_summary(resample.bootstrap(ship_series(spark, sf_dir), "moving_block", DRAWS, SEED, WEEKS)), 5)


def entity_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratios of draws of whole entities."""
    return rounded(resample.entity_bootstrap(ship_panel(spark, sf_dir), THRESHOLDS, DRAWS, SEED, WEEKS), 5)


def romano_wolf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down p-values of the threshold menu."""
    return rounded(resample.romano_wolf(ship_dates(spark, sf_dir), DRAWS, SEED), 5)


def white_reality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reality check of the threshold menu."""
    return rounded(resample.white_reality_check(ship_dates(spark, sf_dir), DRAWS, SEED), 6)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-testing corrections of the HAC p-values."""
    p = series.hac_sharpe(ship_series(spark, sf_dir), WEEKS).select("panel_id", "threshold", F.round("positive_p_value", 6).alias("p"))
    return rounded(resample.corrections(p), 5)


def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated Sharpe ratios for a menu of five trials."""
    return rounded(portfolio.deflated_sharpe(ship_series(spark, sf_dir), len(THRESHOLDS), WEEKS), 5)


def permutation_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratios with signals dealt anew within dates."""
    return rounded(resample.permuted_sharpe(ship_panel(spark, sf_dir), THRESHOLDS, PERMS, SEED, WEEKS), 5)


def observed_sharpe(own: DataFrame) -> DataFrame:
    """keys, observed_sharpe and entities of a panel."""
    entities = own.groupBy("panel_id").agg(F.countDistinct("e_idx").alias("entities"))
    found = aggregate.threshold_sharpe(aggregate.date_returns(own, THRESHOLDS), WEEKS)
    return found.select("panel_id", "threshold", F.col("sharpe").alias("observed_sharpe")).join(F.broadcast(entities), "panel_id")


def grouped_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null of signals dealt anew within rows of the entities' grid, against what was observed."""
    own = kept_panel(spark, sf_dir)
    draws = resample.permuted_sharpe(own, THRESHOLDS, PERMS, SEED, WEEKS, panel.grid_group(5, "row"))
    return rounded(resample.null_summary(draws, observed_sharpe(own)), 5)


def signal_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null of signals and all their ranks dealt anew before positions are taken."""
    returns = written(ship_returns(spark, sf_dir), "returns")
    draws = resample.permuted_sharpe(resample.signal_panel(returns, LOOKBACK, SKIP), THRESHOLDS, PERMS, SEED, WEEKS)
    return rounded(resample.null_summary(draws, observed_sharpe(panel.momentum_panel(returns, LOOKBACK, SKIP))), 5)


def placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio by threshold of shuffled signals."""
    own = panel.placebo_panel(ship_returns(spark, sf_dir), LOOKBACK, SKIP, SEED)
    return rounded(aggregate.threshold_sharpe(aggregate.date_returns(own, THRESHOLDS), WEEKS))


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover and its parts."""
    return rounded(portfolio.turnover(ship_panel(spark, sf_dir), THRESHOLDS))


def turnover_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover of the dollar-neutral portfolios."""
    return rounded(portfolio.turnover(ship_panel(spark, sf_dir), THRESHOLDS, "dollar_neutral"))


def cost_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net Sharpe ratios by cost."""
    own = kept_panel(spark, sf_dir)
    return rounded(portfolio.cost_sensitivity(aggregate.date_returns(own, THRESHOLDS), portfolio.turnover(own, THRESHOLDS), WEEKS), 4)


def holdout_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratios of training, holdout and quarters."""
    return rounded(portfolio.holdout_windows(ship_dates(spark, sf_dir), WEEKS), 5)


def nested_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds chosen in expanding folds, and how they did after."""
    return rounded(portfolio.nested_selection(ship_dates(spark, sf_dir), WEEKS), 5)


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds: in sample, and out of sample gross and net of three costs."""
    return rounded(portfolio.walk_forward(kept_panel(spark, sf_dir), THRESHOLDS, WEEKS, DRAWS, SEED), 4)


def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact and viability by size and liquidity."""
    return rounded(portfolio.capacity(ship_panel(spark, sf_dir), THRESHOLDS), 5)


def boundary(own: DataFrame, dates: DataFrame) -> DataFrame:
    """The row boundary of every threshold beside its menu test."""
    return portfolio.row_boundary(own, dates, THRESHOLDS, WEEKS, resample.romano_wolf(dates, DRAWS, SEED))


def row_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled-row inference beside the date's, with the same-date correlation and its design effect."""
    return rounded(boundary(kept_panel(spark, sf_dir), ship_dates(spark, sf_dir)), 5)


def row_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio, error and interval of pooled rows taken as independent."""
    return rounded(resample.row_statistics(ship_panel(spark, sf_dir), THRESHOLDS, WEEKS), 5)


def ship_evidence(spark: SparkSession, sf_dir: str) -> campaign.Evidence:
    """The evidence of the weekly shipment momentum, with the shipments' factors."""
    return campaign.evidence(kept_panel(spark, sf_dir), THRESHOLDS, written(ship_factors(spark, sf_dir), "factors"), WEEKS, DRAWS, PERMS, SEED)


def gate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates judge, of every threshold as a candidate: the tables go into a store and are read back."""
    folder = new_dir(spark, "results")
    campaign.run(ship_evidence(spark, sf_dir), folder)
    return campaign.facts(spark, folder).drop("candidate_id")


def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of every threshold, and the text of the result."""
    gated = portfolio.status_label(portfolio.gates(gate_facts(spark, sf_dir)))
    return rounded(gated.select(
        "panel_id", "threshold", "holdout_sharpe", "positive_quarters", "hac_p", "romano_wolf_p", "permutation_p", "permutation_status", "row_p", "net_sharpe_5bps",
        *(f"passes_{c}" for c in portfolio.CHECKS), "passes_all", "passes_applicable", "audit_p", "status_label",
    ), 5)


def with_failed(facts: DataFrame) -> DataFrame:
    """Every threshold as a candidate, and one that failed to load."""
    own = facts.withColumn("candidate_id", F.concat(F.lit("threshold "), F.format_string("%.1f", "threshold")))
    return own.unionByName(own.limit(1).select(F.lit("not loaded").alias("candidate_id"), F.lit("failed").alias("status")), allowMissingColumns=True)


def gate_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-check rule at two levels; a candidate that failed stays as a row."""
    found = portfolio.gate_sensitivity(with_failed(gate_facts(spark, sf_dir)))
    return rounded(found.select(
        "candidate_id", "alpha", "status", "passes_hac", "passes_bootstrap", "passes_romano_wolf", "passes_permutation", "permutation_status", "permutation_informative",
        "passes_net_5bps", "passes_all", "passes_applicable", "bootstrap_p",
    ), 5)


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates pass at each level."""
    return rounded(portfolio.gate_counts(portfolio.gate_sensitivity(with_failed(gate_facts(spark, sf_dir)))))


def inference_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inference records of five bootstraps side by side."""
    own = kept_panel(spark, sf_dir)
    of_series = written(aggregate.series_of(aggregate.date_returns(own, THRESHOLDS)), "series")
    return rounded(resample.compared_methods(own, of_series, THRESHOLDS, DRAWS, SEED, WEEKS), 5)


def menu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference of every threshold with two corrections for the menu."""
    own = kept_panel(spark, sf_dir)
    dates = written(aggregate.date_returns(own, THRESHOLDS), "dates")
    of_series = written(aggregate.series_of(dates), "series")
    out = None
    for name in ("holm", "romano_wolf"):
        rows = resample.menu_table(own, dates, of_series, DRAWS, SEED, WEEKS, name).withColumn("correction", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def menu_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference of every threshold with two corrections for the menu."""
    return rounded(menu_rows(spark, sf_dir), 5)


def month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PANEL that holds every nation's monthly orders, from the first return on."""
    return panel.constant_long_panel(panel.returns_of(panels.order_month(spark, sf_dir))).filter("t_idx > 0")


def dependence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective size, autocorrelations and mean correlation of holding all nations' orders."""
    own = written(month_panel(spark, sf_dir), "panel")
    return rounded(dependence.dependence_summary(own, written(aggregate.series_of(aggregate.date_returns(own, (0.5,))), "series")), 5)


def pairwise_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean correlation of the nations' shipments on the dates that two of them have."""
    return rounded(dependence.pairwise_correlation(panel.constant_long_panel(ship_returns(spark, sf_dir))), 5)


def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance inflation and information ratio by the design effect, as they are and floored."""
    own = kept_panel(spark, sf_dir)
    dates = written(aggregate.date_returns(own, THRESHOLDS), "dates")
    found = portfolio.row_boundary(own, dates, THRESHOLDS, WEEKS).withColumnRenamed("trading_moulton_factor", "sei")
    return rounded(robustness.inflation(found), 5)


def fixed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAC at shares of the length, calibrated by simulation (no SQL form: its random streams are numpy's)."""
    return rounded(robustness.fixed_b(ship_series(spark, sf_dir), WEEKS), 5)


def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-root and stationarity tests with the rolling Sharpe ratio."""
    return rounded(robustness.stationarity(ship_series(spark, sf_dir), WEEKS), 5)


def order_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest order that leaves an edge, in a market of given volume and impact."""
    own = kept_panel(spark, sf_dir)
    dates = written(aggregate.date_returns(own, THRESHOLDS), "dates")
    stats = dates.groupBy(*aggregate.KEYS).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n"))
    facts = stats.join(portfolio.turnover(own, THRESHOLDS).select(*aggregate.KEYS, "daily_turnover"), list(aggregate.KEYS))
    effect = portfolio.row_boundary(own, dates, THRESHOLDS, WEEKS).select(*aggregate.KEYS, F.coalesce("trading_moulton_factor", F.lit(1.0)).alias("moulton"))
    facts = facts.join(effect, list(aggregate.KEYS))
    found = portfolio.order_size_bound(facts, 1000.0, 0.1, 0.5)
    return rounded(found.select(*aggregate.KEYS, "order_size"), 4)


def direct_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static ranking against the last nation less the first."""
    returns = written(ship_returns(spark, sf_dir), "returns")
    return rounded(factors.direct_benchmark(aggregate.date_returns(panel.static_rank_panel(returns), THRESHOLDS), returns, WEEKS), 5)


def block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source and content: the weekly returns as a text file in per cent, with a sentinel for what is
    missing, notes above and another table below."""
    number = F.when(F.col("ret").isNull(), F.when(F.col("e_idx") % 2 == 0, "-99.99").otherwise("-999")).otherwise(F.format_string("%.12f", 100 * F.col("ret")))
    cells = ship_returns(spark, sf_dir).groupBy("panel_id", "date").agg(F.array_sort(F.collect_list(F.struct("e_idx", number.alias("text")))).alias("cells"))
    line = F.concat(F.date_format("date", "yyyyMMdd"), F.lit(", "), F.array_join(F.transform("cells", lambda c: c["text"]), ", "))
    table = cells.groupBy("panel_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("table"))
    content = F.concat(F.lit("Weekly returns, per cent\n\n, A, B\n"), F.col("table"), F.lit("\n\nAnnual returns\n19920101, 5.0\n"))
    return table.select(F.col("panel_id").alias("source"), content.alias("content"))


def block_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first table of a text file, read back as returns."""
    found = texts.portfolio_returns(block_text(spark, sf_dir), "text", tail=100)
    return rounded(found.select("panel_id", "t_idx", "e_idx", "entity", F.date_format("date", "yyyy-MM-dd").alias("date"), "ret"))


def of_blocks(found: DataFrame) -> DataFrame:
    """The returns of tables in blocks, as ``block_returns`` shows them."""
    own = texts.returns_of_blocks(found, "text", tail=100)
    return rounded(own.select("panel_id", "t_idx", "e_idx", "entity", F.date_format("date", "yyyy-MM-dd").alias("date"), "ret"))


def piece_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file read in pieces of 4 KB."""
    folder = new_dir(spark, "block-text")
    storage.write_files(block_text(spark, sf_dir).select(F.concat("source", F.lit(".csv")).alias("name"), F.col("content").cast("binary").alias("content")), folder)
    return of_blocks(pieces.blocks(spark, folder, "P", 0, split=4096))


def archive_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same file from a zip archive."""
    folder = new_dir(spark, "block-archive")
    storage.write_files(archives.packed(block_text(spark, sf_dir)), folder)
    return of_blocks(archives.blocks(spark, folder, "P", 0))


def price_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source and content: monthly orders of six nations as price files, one of them without closing prices."""
    values = panels.order_month(spark, sf_dir).filter("entity < 6")
    line = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(",1.0,"), F.format_string("%.4f", "value"))
    found = values.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    head = F.when(F.col("entity") == 5, "Date,Open,Last").otherwise("Date,Open,Close")
    return found.select(F.concat(F.lit("n"), F.col("entity").cast("string")).alias("source"), F.concat(head, F.lit("\n"), F.col("lines"), F.lit("\nno date,1,2\n")).alias("content"))


def price_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the symbols whose files have prices, on their common calendar."""
    found, _ = texts.prices(written(price_text(spark, sf_dir), "prices"))
    own = texts.price_returns(written(found, "closes"), "prices", tail=40)
    return rounded(own.select("panel_id", "t_idx", "e_idx", "entity", "ret"))


def price_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols whose files have none."""
    return texts.prices(written(price_text(spark, sf_dir), "prices"))[1]


def factor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly orders as a wide table of text."""
    values = panels.order_month(spark, sf_dir)
    value = lambda e: F.format_string("%.6f", F.sum(F.when(F.col("entity") % 3 == e, F.col("value"))))
    there = F.count_if(F.col("entity") % 3 == 1) > 0
    return values.groupBy(F.date_format("date", "yyyy-MM-dd").alias("Month")).agg(value(0).alias("Value US"), F.when(there, value(1)).alias("Momentum All"), F.lit("x").alias("Note"))


def factor_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named column of a wide table of text, in hundreds."""
    found = texts.factor_series(written(factor_text(spark, sf_dir), "wide"), ("quality", "momentum"))
    return rounded(found.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "entity", "ret"), 4)


def workbook_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same column from a workbook: notes, an empty sheet and a sheet that is too short stand before the table."""
    rows = factor_text(spark, sf_dir).select(F.lit("factors.xlsx").alias("name"), F.struct("Month", "Value US", "Momentum All", "Note").alias("row"))

    @F.pandas_udf("binary")
    def book(tables: pd.Series) -> pd.Series:
        out = []
        for table in tables:
            found = [[r["Month"], *(None if r[c] in (None, "null") else float(r[c]) for c in ("Value US", "Momentum All")), r["Note"]] for r in table]
            head = [["Notes on the factors"], [], ["Month", "Value US", "Momentum All", "Note"]]
            out.append(workbooks.written_book({"Empty": [], "Short": [["Date", "x"], ["2020-01-01", 1.0]], "Factors": head + found}))
        return pd.Series(out)

    whole = rows.groupBy("name").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    folder = new_dir(spark, "workbooks")
    storage.write_files(whole.select("name", book("rows").alias("content")), folder)
    found = texts.factor_series(written(workbooks.wide(written(workbooks.cells(spark, folder), "cells")), "wide"), ("quality", "momentum"))
    return rounded(found.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "entity", "ret"), 4)


def ship_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACTORS from the shipments: the mean of all nations, spreads between some, and momentum from the tenth week on."""
    ret, e = F.col("ret"), F.col("e_idx")
    returns = written(ship_returns(spark, sf_dir), "returns")
    spread = lambda a, b: F.avg(F.when(a, ret)) - F.avg(F.when(b, ret))
    base = returns.groupBy("date").agg(F.avg(ret).alias("mkt_rf"), spread(e < 5, e >= 20).alias("smb"), spread(e % 2 == 0, e % 2 == 1).alias("hml"), F.lit(0.0001).alias("rf"))
    own = returns.filter("t_idx >= 10").groupBy("date").agg(spread(e % 3 == 0, e % 3 == 1).alias("mom"))
    return texts.joined_factors(base, own)


def factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors, momentum where it has the date."""
    return rounded(ship_factors(spark, sf_dir).withColumn("date", F.date_format("date", "yyyy-MM-dd")))


def aligned_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date returns beside the factors of their dates."""
    found = factors.aligned(ship_dates(spark, sf_dir), ship_factors(spark, sf_dir))
    return rounded(found.groupBy("panel_id", "threshold").agg(
        F.count(F.lit(1)).alias("n"), *(F.corr("ret", f).alias(f"corr_{f}") for f in factors.REGRESSORS)
    ))


def factor_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the factors leave of the returns."""
    return rounded(factors.factor_alpha(ship_dates(spark, sf_dir), ship_factors(spark, sf_dir), WEEKS), 6)


def report_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training, holdout, worst and best quarter at the primary threshold."""
    windows = portfolio.holdout_windows(ship_dates(spark, sf_dir), WEEKS).filter(F.col("threshold") == PRIMARY)
    return rounded(reports.holdout(with_id(windows)), 5)


def report_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs at the primary threshold of what isn't a single series."""
    own = kept_panel(spark, sf_dir)
    dates = aggregate.date_returns(own, (PRIMARY,))
    found = with_id(portfolio.cost_sensitivity(dates, portfolio.turnover(own, (PRIMARY,)), WEEKS))
    kinds = spark.createDataFrame([("ship_week", "panel"), ("none", "single_series_factor")], "candidate_id string, candidate_type string")
    return rounded(reports.costs(found, kinds), 4)


def report_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block bootstrap, HAC and prewhitened HAC at the primary threshold."""
    own = ship_series(spark, sf_dir).filter(F.col("threshold") == PRIMARY)
    record = resample.inference(own, resample.bootstrap(own, "moving_block", DRAWS, SEED, WEEKS), WEEKS)
    methods = record.withColumnRenamed("positive_p_value", "p_positive").withColumnRenamed("n_nominal", "n")
    found = reports.inference_long(with_id(methods), with_id(series.hac_sharpe(own, WEEKS)), with_id(robustness.prewhitened_hac(own, WEEKS)))
    return rounded(found, 4)


def report_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some bandwidths and the prewhitened error at the primary threshold."""
    own = ship_series(spark, sf_dir).filter(F.col("threshold") == PRIMARY)
    fixed = spark.createDataFrame([], "candidate_id string, b double, sharpe double, se double, fixedb_positive_p double")
    return rounded(reports.robustness(with_id(series.bandwidth_sweep(own, WEEKS)), with_id(robustness.prewhitened_hac(own, WEEKS)), fixed), 4)


def report_fixed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the row calibrated at a tenth of the length (no SQL form: see ``fixed_b``)."""
    own = ship_series(spark, sf_dir).filter(F.col("threshold") == PRIMARY)
    fixed = with_id(robustness.fixed_b(own, WEEKS))
    return rounded(reports.robustness(with_id(series.bandwidth_sweep(own, WEEKS)), with_id(robustness.prewhitened_hac(own, WEEKS)), fixed), 4)


def report_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled-row against date-level p-values at the primary threshold."""
    own = kept_panel(spark, sf_dir)
    dates = written(aggregate.date_returns(own, THRESHOLDS), "dates")
    rows = boundary(own, dates).filter(F.col("threshold") == PRIMARY)
    of_series = written(aggregate.series_of(dates).filter(F.col("threshold") == PRIMARY), "series")
    draws = resample.bootstrap(of_series, "iid", DRAWS, SEED, WEEKS).unionByName(resample.bootstrap(of_series, "moving_block", DRAWS, SEED, WEEKS))
    return rounded(reports.comparator(with_id(rows), with_id(resample.draw_summary(draws))), 4)


def report_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row boundary of the threshold nearest to 0.45, its counts beside its p-values."""
    rows = with_id(boundary(kept_panel(spark, sf_dir), ship_dates(spark, sf_dir)))
    one = reports.primary_rows(rows, 0.45)
    return rounded(reports.boundary_counts(one).join(reports.boundary_p_values(one).drop("threshold"), "candidate_id"), 4)


def report_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold as a candidate with its gate at 5 %; what failed to load is left out."""
    facts = with_failed(gate_facts(spark, sf_dir)).withColumn("candidate_type", F.lit("panel"))
    return rounded(reports.candidates(facts, portfolio.gate_sensitivity(facts), ("panel",)), 4)


def report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates with the text of their evaluation."""
    facts = with_failed(gate_facts(spark, sf_dir)).withColumn("candidate_type", F.lit("panel"))
    audits = portfolio.status_label(portfolio.gates(facts.filter("status = 'ok'")))
    found = reports.panel_status(reports.candidates(facts, portfolio.gate_sensitivity(facts)), audits)
    return rounded(found.select("candidate_id", "gross_sharpe", "full_rule", "status_label"), 4)


def report_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation nulls that ran."""
    own = kept_panel(spark, sf_dir)
    null = resample.null_summary(resample.permuted_sharpe(own, THRESHOLDS, PERMS, SEED, WEEKS, panel.grid_group(5, "row")), observed_sharpe(own))
    return rounded(reports.permutations(with_id(null)), 4)


def report_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected p-values of the menu, a column for each correction."""
    return rounded(reports.thresholds_wide(with_id(menu_rows(spark, sf_dir))), 4)


def report_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of the lookback at the primary threshold."""
    returns, own = written(ship_returns(spark, sf_dir), "returns"), None
    for lookback in (1, 4, 13):
        rows = panel.momentum_panel(returns, lookback, SKIP).withColumn("panel_id", F.lit(f"{lookback:02d}"))
        own = rows if own is None else own.unionByName(rows)
    own, keys = written(own, "panel"), list(aggregate.KEYS)
    dates = written(aggregate.date_returns(own, (PRIMARY,)), "dates")
    of_series = written(aggregate.series_of(dates), "series")
    costs = portfolio.cost_sensitivity(dates, portfolio.turnover(own, (PRIMARY,)), WEEKS, (5,)).select(*keys, "daily_turnover", "gross_sharpe", F.col("net_sharpe").alias("net_sharpe_5bps"))
    names = aggregate.threshold_sharpe(dates, WEEKS).select(*keys, "n_dates", "avg_names")
    held = own.filter((F.col("conf") >= PRIMARY) & F.col("realised").isNotNull()).select(
        "panel_id", F.lit(PRIMARY).alias("threshold"), (F.col("t_idx").cast("long") * (1 << 31) + F.col("e_idx")).alias("u"), F.col("realised").alias("r")
    )
    uvif = robustness.sharpe_inflation(of_series, held, WEEKS).select(*keys, "uvif_sr")
    size = series.sharpe_effective_size(of_series, WEEKS).select(*keys, (F.col("se_inflation") * F.col("se_inflation")).alias("serial_uvif_sr"))
    hac = series.hac_sharpe(of_series, WEEKS).select(*keys, F.col("positive_p_value").alias("hac_p"))
    effects = names.join(costs, keys).join(uvif, keys).join(size, keys).join(hac, keys).withColumn("lookback", F.col("panel_id").cast("int"))
    return rounded(reports.horizons(effects), 4)


def head_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty dates of the returns."""
    return rounded(texts.head(ship_returns(spark, sf_dir)).select("panel_id", "t_idx", "e_idx", "ret"))


def active_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last active date of each threshold, as text."""
    dates = aggregate.date_returns(ship_panel(spark, sf_dir), THRESHOLDS).filter("ret is not null")
    return dates.groupBy("threshold").agg(portfolio.day(F.min("date")).alias("sample_start"), portfolio.day(F.max("date")).alias("sample_end"))


def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that results break, counted while they are written: the campaign's tables, the date returns, a
    benchmark and the files themselves; and candidates that a table doesn't have."""
    folder, own = new_dir(spark, "results"), ship_evidence(spark, sf_dir)
    work = campaign.candidates(own.dates)
    broken = campaign.run(own, folder)
    dates = own.dates.join(F.broadcast(work), list(aggregate.KEYS)).select("candidate_id", "threshold", "t_idx", "ret")
    broken += store.save(dates, folder, "dates", store.required(dates))
    returns = written(ship_returns(spark, sf_dir), "returns")
    bench = factors.direct_benchmark(aggregate.date_returns(panel.static_rank_panel(returns), (0.9,), exposure="dollar_neutral"), returns, WEEKS)
    bench = bench.withColumn("candidate_id", F.lit("static rank"))
    broken += store.save(bench, folder, "momentum_benchmark", store.required(bench) | validation.benchmark_rules())
    files = texts.provenance(spark, folder, ("parquet",)).withColumn("candidate_id", F.lit("all"))
    broken += store.save(files, new_dir(spark, "results"), "provenance", validation.provenance_rules())
    extra = work.unionByName(work.limit(1).withColumn("candidate_id", F.lit("not audited")))
    broken += store.missing(spark, folder, tuple(campaign.TABLES), extra)
    return rounded(spark.createDataFrame(broken, store.VIOLATIONS))


def shared_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that have orders and shipments, and months with shipments alone."""
    month = lambda frame: frame.select(F.date_trunc("month", "date").cast("date").alias("date")).distinct()
    orders, ships = month(panels.order_month(spark, sf_dir)), month(panels.ship_week(spark, sf_dir))
    both = validation.shared_keys(ships, orders).select(portfolio.day("date").alias("month"), F.lit("both").alias("found"))
    gone = validation.missing_keys(ships, orders, "orders").select(F.get_json_object("detail", "$.date").alias("month"), F.lit("shipments").alias("found"))
    return both.unionByName(gone)


def unfinished_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and months of shipments that have no order yet: the work list against what is done."""
    month = lambda frame: frame.select("entity", F.date_trunc("month", "date").cast("date").alias("month")).distinct()
    work, done = month(panels.ship_week(spark, sf_dir)), month(panels.order_month(spark, sf_dir))
    found = portfolio.unfinished(work, done, ["entity", "month"])
    return found.select(F.col("entity").cast("long").alias("entity"), portfolio.day("month").alias("month"))


def uniform_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random counter of each nation, the base of all resampling."""
    return panels.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), counter(SEED, F.col("n_nationkey")).alias("draw"))
