"""Streams against the batch operators: in one run, in any split, after restarts, with late and unordered rows."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import aggregate, panel, portfolio
from panelspark.plans import panel_queries as q
from panelspark.sources import panels
from panelspark.streaming import events, jobs, returns

SMALL = "/root/testdata/sf0.001"
FAR = "2100-01-01 00:00:00"
COLUMNS = ("n_dates", "avg_names", "mean", "sd", "sharpe", "daily_turnover", "turnover_rescale", "turnover_entry_exit_flip", "n_turnover_pairs")


def by_threshold(frame):
    return {r.threshold: [r[c] for c in COLUMNS] for r in frame.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-9, abs=1e-12)


@pytest.fixture(scope="module")
def own(spark):
    frame = panel.momentum_panel(panel.returns_of(panels.event_day(spark, SMALL)), 2, 0).cache()
    yield frame
    frame.unpersist()


@pytest.fixture(scope="module")
def batch(own):
    sharpe = aggregate.threshold_sharpe(aggregate.date_returns(own, q.THRESHOLDS), q.DAYS)
    return by_threshold(sharpe.join(portfolio.turnover(own, q.THRESHOLDS), ["panel_id", "threshold"]))


def split_events(spark, path, pieces):
    """The events in files of consecutive days, one after another."""
    rows = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("piece", F.ntile(pieces).over(q.panel.Window.orderBy(F.to_date("ts"))))
    rows = rows.cache()
    for piece in range(1, pieces + 1):
        rows.filter(F.col("piece") == piece).drop("piece").coalesce(1).write.mode("append").parquet(path)
        yield piece
    rows.unpersist()


def test_one_run_equals_batch(spark, batch, tmp_path):
    found = jobs.replay(spark, f"{SMALL}/events.parquet*", str(tmp_path), q.THRESHOLDS, 2, 0, q.DAYS, FAR)
    close(by_threshold(found), batch)


def test_split_with_restarts_and_late_rows(spark, batch, tmp_path):
    source, work = f"{tmp_path}/events", f"{tmp_path}/work"
    for piece in split_events(spark, source, 4):
        query = jobs.close_days(spark, source, work, files=1, delay="2 days")
        assert events.late_rows(query) == 0
        if piece % 2:  # each run goes on from where the one before ended
            jobs.take_days(spark, work, q.THRESHOLDS, 2, 0, files=1)
            jobs.summarise(spark, work, q.DAYS, files=1)
    events.heartbeat(spark, source, FAR)
    jobs.close_days(spark, source, work, delay="2 days")
    late = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts").limit(3)
    late.coalesce(1).write.mode("append").parquet(source)
    assert events.late_rows(jobs.close_days(spark, source, work, delay="2 days")) > 0
    jobs.take_days(spark, work, q.THRESHOLDS, 2, 0)
    jobs.summarise(spark, work, q.DAYS)
    close(by_threshold(jobs.latest(spark, work)), batch)
    days = spark.read.parquet(f"{work}/days")
    assert days.count() == days.select("date").distinct().count()


def test_date_returns_equal_batch(spark, own, tmp_path):
    """A panel with gaps, entities that come late and ties."""
    rng, rows = random.Random(2), []
    for day in range(60):
        for entity in range(9):
            if rng.random() < 0.8 and not (entity == 7 and day < 20):
                rows.append((f"2020-{1 + day // 28:02d}-{1 + day % 28:02d}", entity, float(rng.choice([0, 1, 2, 2, 3, 5, 8]))))
    values = spark.createDataFrame(rows, "date string, entity int, value double").select(F.lit("p").alias("panel_id"), F.to_date("date").alias("date"), "entity", "value")
    days = values.groupBy("panel_id", "date").agg(F.array_sort(F.collect_list(F.struct("entity", "value"))).alias("cells"))
    for month in (1, 2, 3):
        days.filter(F.month("date") == month).coalesce(1).write.mode("append").parquet(f"{tmp_path}/days")
        jobs.take_days(spark, str(tmp_path), (0.0, 0.4, 0.9), 3, 1, files=1)
    wanted = aggregate.date_returns(panel.momentum_panel(panel.returns_of(values), 3, 1), (0.0, 0.4, 0.9))
    last = values.agg(F.max("date")).first()[0]
    key = lambda frame: {(r.threshold, r.t_idx, r.date): (r.ret, r.n_sel) for r in frame.collect()}
    wanted, found = key(wanted.filter(F.col("date") < F.lit(last))), key(spark.read.parquet(f"{tmp_path}/dates"))
    assert wanted.keys() == found.keys()
    for k, (ret, n) in wanted.items():
        assert found[k][1] == n and (found[k][0] is None) == (ret is None) and (ret is None or found[k][0] == pytest.approx(ret, abs=1e-12))


def test_summaries_of_unordered_dates(spark, own, batch, tmp_path):
    last = own.agg(F.max("t_idx")).first()[0]
    weights = aggregate.target_weights(own, q.THRESHOLDS).filter("weight <> 0").groupBy("panel_id", "threshold", "t_idx")
    weights = weights.agg(F.collect_list(F.col("e_idx").cast("int")).alias("entities"), F.collect_list("weight").alias("weights"))
    rows = aggregate.date_returns(own, q.THRESHOLDS).join(weights, ["panel_id", "threshold", "t_idx"], "left").filter(F.col("t_idx") < last)
    rows = rows.select(
        "panel_id", "threshold", "t_idx", "date", "ret", "n_sel", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("entities", "array<int>"), ("weights", "array<double>"))), F.pmod(F.xxhash64("t_idx", "threshold"), F.lit(5)).alias("part"),
    ).cache()
    for part in range(5):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/shuffled")
        jobs.summarise(spark, str(tmp_path), q.DAYS, files=1, source="shuffled")
    close(by_threshold(jobs.latest(spark, str(tmp_path))), batch)


def test_sessions_equal_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    gap = "6 hours"
    source = f"{tmp_path}/events"
    for _ in split_events(spark, source, 3):
        jobs.close_sessions(spark, source, str(tmp_path), files=1, gap=gap)
    events.heartbeat(spark, source, FAR)
    jobs.close_sessions(spark, source, str(tmp_path), gap=gap)
    found = spark.read.parquet(f"{tmp_path}/sessions")
    key = lambda frame: sorted((r.user_id, r["first"], r["last"], r.n, round(r.value, 4)) for r in frame.collect())
    assert key(found) == key(events.sessions(table, gap))


def test_sessions_are_closed_by_many_tasks(spark, tmp_path):
    """No task goes through all users: each writes those it holds."""
    events.heartbeat(spark, f"{tmp_path}/beats", FAR)
    jobs.close_sessions(spark, f"{SMALL}/events.parquet*", str(tmp_path), gap="6 hours", beats=f"{tmp_path}/beats")
    found = spark.read.parquet(f"{tmp_path}/sessions").groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("user_id").alias("users"))
    users = [r.users for r in found.collect()]
    assert len(users) > 1 and max(users) < sum(users)


def test_midranks():
    import numpy as np

    assert np.allclose(returns.midranks(np.array([3.0, 1.0, 1.0, np.nan, 9.0])), [2 / 3, 1 / 6, 1 / 6, np.nan, 1.0], equal_nan=True)
    assert returns.midranks(np.array([np.nan, 2.0])).tolist()[1] == 1.0
