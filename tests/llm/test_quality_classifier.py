"""Held-out accuracy on the small corpus, and the parts against plain computations."""

import zlib

import numpy as np

from panelspark.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in qc.classify(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    known = [(out[r.doc_id].score, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    right = sum((s >= 0.5) == (q == 1) for s, q in known) / len(known)
    low, high = [s for s, q in known if q == 0], [s for s, q in known if q == 1]
    auc = np.mean([(h > x) + 0.5 * (h == x) for x in low for h in high])
    assert right > 0.95 and auc > 0.97, (right, auc)
    assert qc.accepted(docs, labels).count() == sum(r.predicted for r in out.values())


def test_isotonic_is_the_projection():
    values, weights = np.array([3.0, 1.0, 2.0, 5.0, 4.0]), np.array([1.0, 1.0, 2.0, 1.0, 3.0])
    assert np.allclose(qc.isotonic(values, weights), [2, 2, 2, 4.25, 4.25])


def test_normal_equations_equal_plain_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(qc.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)], "x array<double>, y int").repartition(7)
    model = qc.fit(rows, features=32)
    z = model.features(x)
    want = np.linalg.solve(z.T @ z + 1e-3 * 300 * np.diag([*np.full(32, 1 / 32), 1e-9]), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


def test_nulls_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "x", "b"), (1, "", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = qc.classify(docs, labels).collect()
    assert sorted((r.score, r.predicted) for r in got) == [(0.5, 1)] * 3
    some = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in qc.classify(docs, some).collect())
    assert qc.classify(docs.limit(0), some).collect() == []
