"""The result store: rules counted while writing, tables replaced by candidate, and runs that go on after an interruption."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import campaign, portfolio
from panelspark.plans import panel_queries as q
from panelspark.sources import store

SMALL = "/root/testdata/sf0.001"
DRAWS, PERMS = 40, 20


@pytest.fixture(scope="module")
def own(spark):
    return campaign.evidence(q.kept_panel(spark, SMALL), q.THRESHOLDS, q.written(q.ship_factors(spark, SMALL), "factors"), q.WEEKS, DRAWS, PERMS, q.SEED)


def rows(frame):
    order = sorted(frame.columns)
    return sorted((tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in (r[c] for c in order)) for r in frame.collect()))


def test_rules_are_counted_and_folders_replaced(spark, tmp_path):
    folder = str(tmp_path)
    frame = spark.createDataFrame([("a b", 1.0, 1), ("a b", None, 2), ("c=d/é", float("inf"), None), ("c=d/é", float("nan"), 4)], "candidate_id string, x double, n int")
    broken = store.save(frame, folder, "t", store.required(frame, ("n",)) | {"large": F.col("n") > 3})
    assert sorted(broken) == [("t", "infinite x", 1), ("t", "large", 1), ("t", "missing x", 2)]
    assert rows(store.load(spark, folder, "t")) == rows(frame)
    new = spark.createDataFrame([("a b", 5.0, 5), ("010", 6.0, 6)], "candidate_id string, x double, n int")
    assert store.save(new, folder, "t") == []
    assert rows(store.load(spark, folder, "t")) == rows(frame.filter("candidate_id <> 'a b'").unionByName(new))
    assert store.save(new.limit(0), folder, "empty") == [("empty", "empty", 0)]
    work = spark.createDataFrame([("a b",), ("010",), ("new",)], "candidate_id string")
    assert [r[0] for r in store.unfinished(spark, folder, "t", work).collect()] == ["new"]
    assert store.unfinished(spark, folder, "nothing", work).count() == 3
    assert store.missing(spark, folder, ("t", "nothing"), work) == [("t", "missing candidate", 1), ("nothing", "missing candidate", 3)]


def test_interrupted_run_goes_on(spark, own, tmp_path, monkeypatch):
    whole, cut = f"{tmp_path}/whole", f"{tmp_path}/cut"
    broken = campaign.run(own, whole)
    assert {b[:2] for b in broken} == {("bootstrap", "n_boot below 5000"), ("permutation", "n_perms below 10000")}
    some = campaign.candidates(own.dates).filter("threshold < 0.6")
    campaign.run(own, cut, ("holdout", "hac_delta", "romano_wolf"), some)

    def fails(e):
        raise RuntimeError("interrupted")

    monkeypatch.setitem(campaign.TABLES, "costs", campaign.Table(fails))
    with pytest.raises(RuntimeError, match="interrupted"):
        campaign.run(own, cut)
    with pytest.raises(ValueError, match="no costs"):
        campaign.facts(spark, cut)
    monkeypatch.undo()
    made, save = [], store.save
    monkeypatch.setattr(store, "save", lambda frame, folder, table, rules=None: made.append(table) or save(frame, folder, table, rules))
    campaign.run(own, cut)
    assert made == ["costs", "permutation", "row_boundary", "factor_alpha"]
    for table in campaign.TABLES:
        assert rows(store.load(spark, cut, table)) == rows(store.load(spark, whole, table))
    made.clear()
    assert campaign.run(own, cut) == [] and made == []
    assert rows(portfolio.gates(campaign.facts(spark, cut))) == rows(portfolio.gates(campaign.facts(spark, whole)))


def test_without_factors(spark, own, tmp_path):
    bare = campaign.Evidence(own.panel, own.dates, own.series, None, own.annualise, DRAWS, PERMS, own.seed)
    campaign.run(bare, str(tmp_path), ("factor_alpha",))
    found = store.load(spark, str(tmp_path), "factor_alpha").collect()
    assert len(found) == 5 and {r.status for r in found} == {"not_applicable_no_factor_benchmark"}
