"""The driver's contract, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from panelspark.plans import catalog

SMALL = "/root/testdata/sf0.001"
#: Queries that put together what others here have been compared for; the driver compares them all.
ALIKE = {
    "gate_sensitivity", "gate_counts", "report_candidates", "report_status", "report_permutations", "report_thresholds", "report_comparator", "report_inference",
    "inference_methods", "bootstrap_stationary", "bootstrap_iid", "signal_permutation", "grouped_permutation", "bandwidth_sweep", "threshold_sharpe_monthly",
}
TABLES = ("nation", "customer", "supplier", "orders", "lineitem", "events")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("~" if row[i] is None else f"{row[i]:.5f}" if isinstance(row[i], float) else str(row[i]) for i in order) for row in rows)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - ALIKE))
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = catalog.queries()[name](spark, SMALL)
    wanted = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(names, wanted.fetchall())
