"""Text sources over small files written here."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from panelspark.sources import texts


def test_first_block_with_sentinels(spark, tmp_path):
    lines = ["Some notes, 12345678 words", "", " ,A,B,C"]
    lines += [f"202001{d:02d}, {d}.0, -99.99, {d / 2}" for d in range(1, 11)]
    lines += ["20200111, x, -999, ", "20201399, 1, 2, 3", "", "Annual", "20200112, 7, 8, 9", "footer"]
    (tmp_path / "table.csv").write_text("\r\n".join(lines))
    got = texts.blocks(texts.files(spark, str(tmp_path / "table.csv")), "P", 0)
    rows = {(str(r.date), r.entity): r.value for r in got.collect()}
    assert len(rows) == 33 and rows["2020-01-03", "P00"] == pytest.approx(0.03) and rows["2020-01-03", "P01"] is None and rows["2020-01-04", "P02"] == pytest.approx(0.02)
    assert rows["2020-01-11", "P00"] is None and rows["2020-01-11", "P02"] is None
    returns = texts.portfolio_returns(texts.files(spark, str(tmp_path / "table.csv")), "p", tail=4)
    assert sorted({str(r.date) for r in returns.collect()}) == [f"2020-01-{d:02d}" for d in (7, 8, 9, 10)]
    assert texts.head(returns, 7).count() == 2  # two of three columns have values; dates keep their numbers
    empty = spark.createDataFrame([("e", "no table here")], "source string, content string")
    assert texts.blocks(empty).count() == 0


def test_factors_keep_dates_without_momentum(spark):
    base = spark.createDataFrame([("f", "h\n20200101, 1, 2, 3, 0.1, 9\n20200102, 1, -99.99, 3, 0.1, 9\n")], "source string, content string")
    momentum = spark.createDataFrame([("m", "20200102, 5\n20200103, 6\n")], "source string, content string")
    got = [tuple(r)[1:] for r in texts.factor_table(base, momentum).orderBy("date").collect()]
    assert got[0] == pytest.approx((0.01, 0.02, 0.03, 0.001, None)) and got[1][1] is None and got[1][4] == pytest.approx(0.05) and len(got) == 2


def price_files(spark, symbols):
    rows = []
    for i, s in enumerate(symbols):
        lines = ["Date,Open,Close,Volume"] + [f"2020-02-{d:02d},1,{10 + d + i},5" for d in range(1 + 3 * i, 21)] + ["oops,1,2,3"]
        rows.append((s, "\n".join(lines)))
    return spark.createDataFrame(rows + [("bad", "Get a key")], "source string, content string")


def test_prices_on_a_common_calendar(spark):
    found, notes = texts.prices(price_files(spark, ("a", "b", "c")))
    assert [r.symbol for r in notes.collect()] == ["bad"]
    got = {(str(r.date), r.entity): r.ret for r in texts.price_returns(found, "p").collect()}
    assert len(got) == 19 * 3 and got["2020-02-02", "a"] == pytest.approx(12 / 11 - 1) and got["2020-02-02", "b"] is None
    assert got["2020-02-05", "b"] == pytest.approx(16 / 15 - 1) and got["2020-02-04", "b"] is None
    with pytest.raises(texts.SourceError):
        texts.price_returns(found.filter("symbol <> 'a'"), "p")


def test_factor_series(spark):
    rows = [(f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", str(i % 7 - 3), "" if i == 5 else f"{i % 5 - 2}.5", "note") for i in range(60)]
    wide = spark.createDataFrame(rows, "` Date ` string, `Value US` string, ` Momentum ` string, Text string")
    got = texts.factor_series(wide, ("quality", "mom"))
    assert got.count() == 59 and got.select("entity").distinct().first()[0] == "Momentum"
    assert got.filter("date = '2020-01-01'").first().ret == pytest.approx(-0.025)
    assert texts.factor_series(wide).select("entity").distinct().first()[0] == "Value US"
    with pytest.raises(texts.SourceError):
        texts.factor_series(wide.select("Text", "Value US"))
    with pytest.raises(texts.SourceError):
        texts.factor_series(wide.limit(25))


def test_registry_and_dispatch(spark, tmp_path):
    file = {"version": 1, "created_for": "x", "default_thresholds": [0.0, 0.5], "candidates": [{"id": "a", "loader": "one", "lookback": 21}, {"id": "b", "loader": "two", "thresholds": [0.9]}]}
    (tmp_path / "r.json").write_text(json.dumps(file, indent=1))
    got = {r.id: r for r in texts.registry(spark, str(tmp_path / "r.json")).collect()}
    assert got["a"].thresholds == [0.0, 0.5] and got["b"].thresholds == [0.9] and got["a"].lookback == 21
    assert texts.loaded(got["a"].asDict(), {"one": lambda spec: spec["id"]}) == "a"
    with pytest.raises(texts.SourceError):
        texts.loaded(got["b"].asDict(), {"one": lambda spec: spec["id"]})


def test_sinks_and_provenance(spark, tmp_path):
    frame = spark.createDataFrame([("x", 1, 0.5), ("y", 2, None)], "candidate_id string, b int, a double")
    for kind in ("csv", "json", "parquet"):
        for _ in range(2):  # over what is there
            texts.write_table(frame, str(tmp_path / kind), kind, "candidate_id")
        assert sorted(p.name for p in (tmp_path / kind).iterdir() if p.is_dir()) == ["candidate_id=x", "candidate_id=y"]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert [r.value for r in texts.as_json(frame).collect()] == ['{"a":0.5,"b":1,"candidate_id":"x"}', '{"b":2,"candidate_id":"y"}']
    assert texts.read_json('{"a": 1}') == {"a": 1}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "n.md").write_text("hello")
    got = {r.path.rsplit("/", 1)[1]: r for r in texts.provenance(spark, str(tmp_path), ("md",)).collect()}
    assert got["n.md"].bytes == 5 and got["n.md"].sha256 == hashlib.sha256(b"hello").hexdigest()


def test_cleaning(spark):
    frame = spark.createDataFrame([(-99.99, None), (math.nan, None), (math.inf, None), (1.5, None)], "x double, y double")
    assert [r[0] for r in frame.select(texts.without_sentinels(F.col("x"))).collect()] == [None, None, None, 1.5]
    assert texts.dropna_columns(frame, ["x", "y"]) == ["x"]
