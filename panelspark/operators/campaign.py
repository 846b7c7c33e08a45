"""The evidence on candidates, table by table into a store, and the gates from what the store holds.

A candidate is a threshold of a panel. Each table is computed for the candidates that it doesn't have yet, in one
pass for all of them, so a run that was interrupted goes on where it ended, and a finished one
computes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import aggregate, factors, portfolio, resample, series, validation
from panelspark.sources import store
from panelspark.tables import written

KEYS = list(aggregate.KEYS)


@dataclass(frozen=True)
class Evidence:
    """What the tables are made from: a panel, its date returns and series, factors (or none), and the scale of resampling."""

    panel: DataFrame
    dates: DataFrame
    series: DataFrame
    factors: DataFrame | None
    annualise: float
    draws: int
    perms: int
    seed: int

    def thresholds(self) -> tuple[float, ...]:
        """The menu: a few values."""
        return tuple(sorted(r["threshold"] for r in self.dates.select("threshold").distinct().collect()))

    def only(self, work: DataFrame) -> Evidence:
        """The same with the candidates of ``work`` alone in the date returns and series."""
        own = F.broadcast(work.select(*KEYS).distinct())
        return Evidence(self.panel, self.dates.join(own, KEYS, "left_semi"), self.series.join(own, KEYS, "left_semi"), self.factors, self.annualise, self.draws, self.perms, self.seed)


def evidence(panel: DataFrame, thresholds: tuple[float, ...], factors_: DataFrame | None, annualise: float, draws: int, perms: int, seed: int) -> Evidence:
    """The evidence of a panel, which is read several times: date returns and series are written once."""
    dates = written(aggregate.date_returns(panel, thresholds), "dates")
    return Evidence(panel, dates, written(aggregate.series_of(dates), "series"), factors_, annualise, draws, perms, seed)


def _holdout(e: Evidence) -> DataFrame:
    return portfolio.holdout_windows(e.dates, e.annualise)


def _hac(e: Evidence) -> DataFrame:
    size = series.sharpe_effective_size(e.series, e.annualise)
    return series.hac_sharpe(e.series, e.annualise).join(size, KEYS)


def _bootstrap(e: Evidence) -> DataFrame:
    return resample.draw_summary(resample.bootstrap(e.series, "moving_block", e.draws, e.seed, e.annualise)).withColumn("n_boot", F.lit(e.draws))


def _romano_wolf(e: Evidence) -> DataFrame:
    return resample.romano_wolf(e.dates, e.draws, e.seed)


def _costs(e: Evidence) -> DataFrame:
    return portfolio.cost_sensitivity(e.dates, portfolio.turnover(e.panel, e.thresholds()), e.annualise)


def observed(e: Evidence) -> DataFrame:
    """keys, observed_sharpe and entities."""
    entities = e.panel.groupBy("panel_id").agg(F.countDistinct("e_idx").alias("entities"))
    found = aggregate.threshold_sharpe(e.dates, e.annualise)
    return found.select(*KEYS, F.col("sharpe").alias("observed_sharpe")).join(F.broadcast(entities), "panel_id")


def _permutation(e: Evidence) -> DataFrame:
    draws = resample.permuted_sharpe(e.panel, e.thresholds(), e.perms, e.seed, e.annualise)
    return resample.null_summary(draws, observed(e))


def _rows(e: Evidence) -> DataFrame:
    return resample.row_statistics(e.panel, e.thresholds(), e.annualise)


def _alpha(e: Evidence) -> DataFrame:
    if e.factors is not None:
        return factors.factor_alpha(e.dates, e.factors, e.annualise)
    return e.dates.select(*KEYS).distinct().select(*KEYS, *(F.lit(None).cast("double").alias(c) for c in ("alpha_period", "p_positive")), F.lit("not_applicable_no_factor_benchmark").alias("status"))


@dataclass(frozen=True)
class Table:
    """How a table is made; whether one candidate's rows need the whole menu; what may be missing; more rules."""

    make: Callable[[Evidence], DataFrame]
    whole_menu: bool = False
    nullable: tuple[str, ...] = ()
    rules: Callable[[], dict[str, Column]] = dict


TABLES = {
    "holdout": Table(_holdout),
    "hac_delta": Table(_hac),
    "bootstrap": Table(_bootstrap, rules=lambda: {f"n_boot below {validation.FULL_DRAWS}": F.col("n_boot") < validation.FULL_DRAWS}),
    "romano_wolf": Table(_romano_wolf, whole_menu=True, nullable=("block_size",), rules=lambda: {"adjusted below raw": F.col("p_adjusted") + 1e-12 < F.col("p_raw")}),
    "costs": Table(_costs, nullable=("break_even_cost_bps",)),
    "permutation": Table(
        _permutation, nullable=("null_mean", "null_sd", "null_q025", "null_q500", "null_q975", "p_positive"),
        rules=lambda: {f"n_perms below {validation.FULL_PERMS}": (F.col("status") == "ok") & (F.col("n_perms") < validation.FULL_PERMS)},
    ),
    "row_boundary": Table(_rows, nullable=("row_t_stat", "row_p_positive", "row_sharpe", "row_sharpe_se", "row_ci_lo", "row_ci_hi")),
    "factor_alpha": Table(_alpha, nullable=("alpha_period", "alpha_ann", "alpha_se_period", "t_alpha", "hac_lag", "p_positive")),
}


def candidates(dates: DataFrame) -> DataFrame:
    """candidate_id, panel_id and threshold of every threshold."""
    return dates.select(*KEYS).distinct().select(F.format_string("%s threshold %.2f", "panel_id", "threshold").alias(store.CANDIDATE), *KEYS)


def run(e: Evidence, folder: str, tables: tuple[str, ...] = tuple(TABLES), work: DataFrame | None = None) -> list[tuple[str, str, int]]:
    """Write what the store doesn't have of these tables for the candidates of ``work`` (all); the rules that the new rows break."""
    work = candidates(e.dates) if work is None else work
    spark, broken = e.dates.sparkSession, []
    for name in tables:
        todo = written(store.unfinished(spark, folder, name, work), "todo")
        if todo.isEmpty():
            continue
        table = TABLES[name]
        rows = table.make(e if table.whole_menu else e.only(todo)).join(F.broadcast(todo), KEYS)
        broken += store.save(rows, folder, name, store.required(rows, table.nullable) | table.rules())
    return broken


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """What the gates judge, of each candidate that all tables of the store have."""
    key = store.CANDIDATE
    tables = {name: store.load(spark, folder, name) for name in TABLES}
    gone = [name for name, table in tables.items() if table is None]
    if gone:
        raise ValueError(f"the store has no {', '.join(gone)}")
    windows = tables["holdout"].groupBy(key, *KEYS).agg(
        F.max(F.when(F.col("window") == "holdout_30pct", F.col("sharpe"))).alias("holdout_sharpe"),
        F.count_if(F.col("window").startswith("quarter") & (F.col("sharpe") > 0)).alias("positive_quarters"),
    )
    parts = [
        windows,
        tables["hac_delta"].select(key, F.col("positive_p_value").alias("hac_p")),
        tables["bootstrap"].select(key, F.col("p_positive").alias("bootstrap_p")),
        tables["romano_wolf"].select(key, F.col("p_adjusted").alias("romano_wolf_p")),
        tables["costs"].filter("cost_bps_per_rebalance = 5").select(key, "gross_sharpe", F.col("net_sharpe").alias("net_sharpe_5bps")),
        tables["permutation"].select(key, F.col("p_positive").alias("permutation_p"), F.col("status").alias("permutation_status"), "permutation_informative"),
        tables["row_boundary"].select(key, F.col("row_p_positive").alias("row_p")),
        tables["factor_alpha"].select(key, F.col("status").alias("alpha_status"), "alpha_period", F.col("p_positive").alias("alpha_p")),
    ]
    return reduce(lambda a, b: a.join(b, key), parts).withColumn("status", F.lit("ok"))
