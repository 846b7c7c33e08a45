"""Stateful operators: closed days into momentum date returns, and these into running Sharpe ratios and turnover.

Both hold what the next row needs and no more: a panel its last values, signals and ranks; a series the
count, mean and squared deviations of its returns, its last weights and sums over pairs of dates. The
results are those of the batch operators over all dates so far, however the dates are dealt to
micro-batches, and after a restart from the checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Rows of date returns with the weights that are not zero.
RETURNS = "panel_id string, threshold double, t_idx int, date date, ret double, n_sel long, entities array<int>, weights array<double>"
SUMMARY = (
    "panel_id string, threshold double, t_idx int, n_dates long, avg_names double, mean double, sd double, sharpe double, "
    "daily_turnover double, turnover_rescale double, turnover_entry_exit_flip double, n_turnover_pairs long"
)
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def midranks(score: np.ndarray) -> np.ndarray:
    """Midrank percentiles of the scores that are there: 0 to 1, alone 1."""
    out, there = np.full(len(score), np.nan), ~np.isnan(score)
    n = int(there.sum())
    if n == 1:
        out[there] = 1.0
    elif n:
        _, place, count = np.unique(score[there], return_inverse=True, return_counts=True)
        below = np.concatenate(([0], np.cumsum(count)[:-1]))
        out[there] = (below + (count - 1) / 2)[place] / (n - 1)
    return out


class DateReturns(StatefulProcessor):
    """A panel's closed days (``CLOSED``), in order, into date returns (``RETURNS``) of each day, when the next one is there.

    The signal is the return compounded over ``lookback`` days that end ``skip`` days before."""

    def __init__(self, thresholds: tuple[float, ...], lookback: int, skip: int) -> None:
        self.thresholds, self.lookback, self.skip = thresholds, lookback, skip

    def init(self, handle: StatefulProcessorHandle) -> None:
        """One value: the last day, its signals and ranks, and the last values and returns of every entity."""
        self.state = handle.getValueState("panel", "t_idx int, date date, entities array<int>, value array<double>, returns array<double>, pred array<double>, conf array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """Take the days one by one."""
        days = pd.concat(list(rows)).sort_values("date")
        width = self.lookback + self.skip
        if self.state.exists():
            t_idx, last, entities, value, returns, pred, conf = self.state.get()
            entities, value, pred, conf = (np.array(x, dtype=t) for x, t in ((entities, np.int64), (value, float), (pred, float), (conf, float)))
            returns = np.array(returns, dtype=float).reshape(len(entities), width)
        else:
            t_idx, last, entities = -1, None, np.zeros(0, dtype=np.int64)
            value, pred, conf, returns = np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((0, width))
        out = []
        for date, cells in zip(days["date"], days["cells"], strict=True):
            if last is not None and date <= last:
                raise ValueError(f"{key[0]}: {date} comes after {last}")
            new = np.array([c["entity"] for c in cells], dtype=np.int64)
            every = np.union1d(entities, new)
            at = np.searchsorted(every, entities)
            grown = [np.full(len(every), np.nan) for _ in range(4)]
            for target, source in zip(grown, (value, pred, conf), strict=False):
                target[at] = source
            value, pred, conf, now = grown
            past = np.full((len(every), width), np.nan)
            past[at] = returns
            now[np.searchsorted(every, new)] = [math.nan if c["value"] is None else c["value"] for c in cells]
            with np.errstate(divide="ignore", invalid="ignore"):
                ret = np.where(value != 0, now / value - 1, np.nan)
            ret[~np.isfinite(ret)] = np.nan
            if last is not None:
                out += self._of_day(key[0], t_idx, last, every, pred, conf, ret)
            entities, value, t_idx, last = every, now, t_idx + 1, date
            returns = np.concatenate([past[:, 1:], ret[:, None]], axis=1)
            pred = np.prod(1 + returns[:, : self.lookback], axis=1) - 1
            conf = midranks(np.abs(pred))
        self.state.update((t_idx, last, entities.tolist(), value.tolist(), returns.ravel().tolist(), pred.tolist(), conf.tolist()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RETURNS.split(", ")])

    def _of_day(self, panel_id: str, t_idx: int, date, entities: np.ndarray, pred: np.ndarray, conf: np.ndarray, after: np.ndarray) -> list[tuple]:
        side = np.sign(np.nan_to_num(pred))
        held, out = (side != 0) & ~np.isnan(after), []
        for threshold in self.thresholds:
            chosen = held & (np.nan_to_num(conf, nan=-1.0) >= threshold)
            n = int(chosen.sum())
            ret = float(np.mean(side[chosen] * after[chosen])) if n else None
            out.append((panel_id, threshold, t_idx, date, ret, n, entities[chosen].tolist(), (side[chosen] / max(n, 1)).tolist()))
        return out

    def close(self) -> None:
        """Nothing is held open."""


class RunningSummary(StatefulProcessor):
    """Date returns (``RETURNS``) of a series into its summary (``SUMMARY``) over all dates without a gap so far.

    Dates may come in any order: those beyond a gap wait in the state. The turnover has the exit of what
    is held on the last date, as the batch operator has on the date that follows it."""

    def __init__(self, annualise: float) -> None:
        self.annualise = annualise

    def init(self, handle: StatefulProcessorHandle) -> None:
        """The sums, the last weights, and the dates that wait."""
        self.sums = handle.getValueState(
            "sums", "next int, n long, mean double, squares double, named long, names long, total double, rescale double, rest double, pairs long, entities array<int>, weights array<double>"
        )
        self.waiting = handle.getMapState("waiting", "t_idx int", "ret double, n_sel long, entities array<int>, weights array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """Take the dates that follow what is there, and give the summary up to them."""
        s = list(self.sums.get()) if self.sums.exists() else [0, 0, 0.0, 0.0, 0, 0, 0.0, 0.0, 0.0, 0, [], []]
        came = {}
        for frame in rows:
            for t, ret, n_sel, entities, weights in zip(frame["t_idx"], frame["ret"], frame["n_sel"], frame["entities"], frame["weights"], strict=True):
                came[int(t)] = (None if ret is None or math.isnan(ret) else float(ret), int(n_sel), [int(e) for e in entities], [float(w) for w in weights])
        while True:
            t = s[0]
            if t in came:
                row = came.pop(t)
            elif self.waiting.containsKey((t,)):
                row = self.waiting.getValue((t,))
                self.waiting.removeKey((t,))
            else:
                break
            self._take(s, *row)
        for t, row in came.items():
            if t < s[0]:
                raise ValueError(f"{key}: date {t} came twice")
            self.waiting.updateValue((t,), row)
        self.sums.update(tuple(s))
        yield pd.DataFrame([self._summary(key, s)], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    @staticmethod
    def _moved(before: dict[int, float], after: dict[int, float]) -> tuple[float, float]:
        total = rescale = 0.0
        for e in before.keys() | after.keys():
            a, b = before.get(e, 0.0), after.get(e, 0.0)
            total += 0.5 * abs(b - a)
            if a * b > 0:
                rescale += 0.5 * abs(b - a)
        return total, rescale

    def _pair(self, s: list, after: dict[int, float]) -> None:
        before = dict(zip(s[10], s[11], strict=True))
        if s[0] and (before or after):
            total, rescale = self._moved(before, after)
            s[6], s[7], s[8], s[9] = s[6] + total, s[7] + rescale, s[8] + max(total - rescale, 0.0), s[9] + 1

    def _take(self, s: list, ret: float | None, n_sel: int, entities: list[int], weights: list[float]) -> None:
        self._pair(s, dict(zip(entities, weights, strict=True)))
        if ret is not None:
            s[1] += 1
            step = ret - s[2]
            s[2] += step / s[1]
            s[3] += step * (ret - s[2])
        if n_sel:
            s[4], s[5] = s[4] + 1, s[5] + n_sel
        s[0], s[10], s[11] = s[0] + 1, list(entities), list(weights)

    def _summary(self, key: tuple, s: list) -> tuple:
        after = list(s)
        self._pair(after, {})
        total, rescale, rest, pairs = after[6:10]
        sd = math.sqrt(s[3] / (s[1] - 1)) if s[1] > 1 else None
        sharpe = s[2] / sd * math.sqrt(self.annualise) if sd else 0.0
        share = max(pairs, 1)
        return (*key, s[0] - 1, s[1], s[5] / s[4] if s[4] else None, s[2] if s[1] else None, sd, sharpe, total / share, rescale / share, rest / share, pairs)

    def close(self) -> None:
        """Nothing is held open."""


def date_returns(days: DataFrame, thresholds: tuple[float, ...], lookback: int, skip: int) -> DataFrame:
    """``RETURNS`` of a stream of closed days: a panel's cross-section is one task's, as its ranks ask for."""
    return days.groupBy("panel_id").transformWithStateInPandas(DateReturns(thresholds, lookback, skip), RETURNS, "Append", "None")


def running_summary(dates: DataFrame, annualise: float) -> DataFrame:
    """``SUMMARY`` of a stream of date returns: a row for each series with new dates in a micro-batch."""
    return dates.groupBy("panel_id", "threshold").transformWithStateInPandas(RunningSummary(annualise), SUMMARY, "Update", "None")
