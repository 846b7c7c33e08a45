"""From values to the strategy panel.

RETURNS  panel_id, t_idx, date, e_idx, entity, ret
PANEL    panel_id, t_idx, date, e_idx, entity, pred, realised, conf

``t_idx`` and ``e_idx`` are dense from 0. Missing is null, never NaN. Work along time is
partitioned by (panel_id, e_idx), work across entities by (panel_id, t_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.special import counter, finite, sign

ALONG = ("panel_id", "e_idx")
ACROSS = ("panel_id", "t_idx")
SALTS = 64
IDS = ("panel_id", "t_idx", "date", "e_idx", "entity")


def along_time():
    """The window of one entity, by date."""
    return Window.partitionBy(*ALONG).orderBy("t_idx")


def dense_grid(values: DataFrame) -> DataFrame:
    """Every date with every entity of its panel, numbered densely; value null where there is none."""
    # dates and entities are dimensions: thousands a panel, numbered panel by panel
    dates = values.select("panel_id", "date").distinct()
    dates = dates.withColumn("t_idx", F.row_number().over(Window.partitionBy("panel_id").orderBy("date")) - 1)
    entities = values.select("panel_id", "entity").distinct()
    entities = entities.withColumn("e_idx", F.row_number().over(Window.partitionBy("panel_id").orderBy("entity")) - 1)
    # dates are dealt to SALTS keys of each panel, so that its grid is built by as many tasks
    salted = dates.withColumn("salt", F.pmod("t_idx", F.lit(SALTS)))
    every = entities.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["panel_id", "salt"]).join(values, ["panel_id", "date", "entity"], "left").select(*IDS, "value")


def simple_returns(grid: DataFrame) -> DataFrame:
    """ret: value / previous value - 1, null where either is missing or the previous is 0."""
    previous = F.lag("value").over(along_time())
    return grid.select(*IDS, finite(F.try_divide(F.col("value"), previous) - 1).alias("ret"))


def returns_of(values: DataFrame) -> DataFrame:
    """RETURNS of a value panel."""
    return simple_returns(dense_grid(values))


def compounded(ret: Column, lookback: int, skip: int) -> Column:
    """The return compounded over ``lookback`` rows that end ``skip`` rows ago; null unless all are there."""
    if lookback <= 0 or skip < 0:
        raise ValueError("lookback must be positive and skip not negative")
    frame = along_time().rowsBetween(-(lookback + skip - 1), -skip)
    return F.when(F.count(ret).over(frame) == lookback, F.product(1 + ret).over(frame) - 1)


def rank_confidence(score: Column) -> Column:
    """Midrank percentile of a score among the non-null ones of its date: 0 to 1, alone 1."""
    there = score.isNotNull()
    by_date = Window.partitionBy(*ACROSS)
    order = Window.partitionBy(*ACROSS, there).orderBy(score)
    n = F.count(score).over(by_date)
    ties = F.count(score).over(Window.partitionBy(*ACROSS, score))
    rank = F.rank().over(order) + (ties - 1) / 2
    return F.when(there, F.when(n == 1, 1.0).otherwise(F.try_divide((rank - 1).cast("double"), (n - 1).cast("double"))))


def with_positions(scored: DataFrame, confidence: Column | None = None) -> DataFrame:
    """PANEL from rows with ``pred`` and ``next_ret`` (the return of the following date).

    Ranks are taken over all scores, zero ones included, and only then nulled where no
    position is held."""
    side = sign(F.col("pred"))
    held = (side != 0) & F.col("next_ret").isNotNull()
    ranked = scored.withColumn("rank_conf", rank_confidence(F.abs("pred")) if confidence is None else confidence)
    return ranked.select(
        *IDS, "pred", F.when(held, side * F.col("next_ret")).alias("realised"), F.when(held, F.col("rank_conf")).alias("conf")
    )


def momentum_panel(returns: DataFrame, lookback: int = 4, skip: int = 1) -> DataFrame:
    """PANEL whose signal is the skipped compounded return."""
    scored = returns.withColumn("pred", compounded(F.col("ret"), lookback, skip)).withColumn("next_ret", F.lead("ret").over(along_time()))
    return with_positions(scored)


def static_rank_panel(returns: DataFrame) -> DataFrame:
    """PANEL whose signal is the entity's place, the same on all dates: 2 e_idx - (N - 1)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*ACROSS))
    scored = returns.withColumn("next_ret", F.lead("ret").over(along_time())).withColumn("pred", (2 * F.col("e_idx") - (n - 1)).cast("double"))
    return with_positions(scored)


def constant_long_panel(returns: DataFrame) -> DataFrame:
    """PANEL that always holds everything: the return of the same date."""
    there = F.col("ret").isNotNull()
    return returns.select(*IDS, F.lit(1.0).alias("pred"), F.col("ret").alias("realised"), F.when(there, 1.0).alias("conf"))


def raw_returns(panel: DataFrame) -> DataFrame:
    """PANEL with ``raw``: the return before the position's side was applied."""
    return panel.withColumn("raw", F.try_divide(F.col("realised"), F.nullif(sign(F.col("pred")), F.lit(0.0))))


def placebo_panel(returns: DataFrame, lookback: int, skip: int, seed: int) -> DataFrame:
    """PANEL whose signals are shuffled once among the entities that have one, date by date."""
    scored = returns.withColumn("pred", compounded(F.col("ret"), lookback, skip)).withColumn("next_ret", F.lead("ret").over(along_time()))
    there = scored.filter("pred is not null").withColumn("key", counter(seed, F.col("t_idx"), F.col("e_idx")))
    by_date = Window.partitionBy(*ACROSS)
    places = there.select("panel_id", "t_idx", "e_idx", F.row_number().over(by_date.orderBy("e_idx")).alias("nth"))
    dealt = there.select("panel_id", "t_idx", "pred", F.row_number().over(by_date.orderBy("key", "e_idx")).alias("nth"))
    shuffled = places.join(dealt, ["panel_id", "t_idx", "nth"]).drop("nth")
    return with_positions(scored.drop("pred").join(shuffled, ["panel_id", "t_idx", "e_idx"], "left"))


def last_dates(frame: DataFrame, k: int) -> DataFrame:
    """The rows of each panel's last ``k`` dates; all for 0."""
    if not k:
        return frame
    last = frame.groupBy("panel_id").agg(F.max("t_idx").alias("last"))
    return frame.join(last, "panel_id").filter(F.col("t_idx") > F.col("last") - k).drop("last")


def grid_group(side: int, by: str) -> Column:
    """The row or column of an entity on a square grid of ``side`` entities a row."""
    return F.expr(f"e_idx div {side}") if by == "row" else F.col("e_idx") % side
