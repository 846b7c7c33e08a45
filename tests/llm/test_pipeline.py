"""The pipeline from end to end against plain computations of its stages."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as cp
from panelspark import tables as tables_module
from panelspark.llm import quality_classifier as qc
from test_decontamination import plain as plain_hits
from test_near_copies import plain_groups

WINDOW = 35


def tables(spark, folder, documents, labels, benchmark):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, row string, score int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def corpus():
    rng = random.Random(17)
    vocabulary = [f"{a}{b}" for a in ("bor", "kel", "min", "tas", "wu", "ner") for b in ("an", "el", "ist", "o", "ung", "ery", "ash")]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(line(20))) for i in range(3)]
    passage = line(60)
    good = [" ".join(line(rng.randrange(80, 160))) for _ in range(40)]
    good += [" ".join([*line(50), *passage, *line(50)]) for _ in range(3)]
    good += [" ".join([*line(40), *items[0][1].split(), *line(20)])]
    words = good[0].split()
    good += [good[0], " ".join([*words[:60], "changed", *words[61:]]), good[1] + " and"]
    junk = ["#$%&|<> " * rng.randrange(10, 40) for _ in range(30)]
    texts = [x for pair in zip(good, junk + [None, "", " \n"] + junk[:14], strict=False) for x in pair]
    documents = [(None if i == 5 else i, t, "en", f"r{i}", i) for i, t in enumerate(texts)] + [(0, texts[0], "en", "again", 9)]
    labels = [(i, int(t is not None and t in good), 0) for i, t in enumerate(texts) if i % 2 or i > 20]
    return documents, labels, items


def cut(rows):
    """Texts without the words of windows that start elsewhere too."""
    held = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + WINDOW]) for w in held for i in range(len(w) - WINDOW + 1))
    out = []
    for (d, t), w in zip(rows, held, strict=True):
        gone = {j for i in range(len(w) - WINDOW + 1) if seen[tuple(w[i : i + WINDOW])] > 1 for j in range(i, i + WINDOW)}
        out.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else t))
    return out


def test_pipeline_equals_plain(spark, tmp_path):
    documents, labels, items = corpus()
    folder = tables(spark, tmp_path, documents, labels, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    accepted = cp.quality(spark, docs, folder)
    assert accepted.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in accepted.collect()]
    assert 30 < len(kept) < len(documents)
    # one row of each group of near copies: the one with the smallest doc_id (nulls last); equal rows are one
    groups, best = dict(plain_groups(sorted(set(kept), key=str))), {}
    for d, t in kept:
        best.setdefault(groups[d], (d, t))
        if d == groups[d]:
            best[d] = (d, t)
    rows = [(d, t) for d, t in cut(list(best.values())) if not plain_hits(t, items)[4]]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((d, tuple(model.encode(t or ""))) for d, t in rows)
    got = cp.run(spark, folder).collect()
    assert all(r.round_trip for r in got)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert len(want) < len(kept)


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert cp.run(spark, tables(spark, tmp_path, [], [], [])).collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in cp.STAGES])
def test_stages_are_named(stage):
    assert stage


def test_classifier_equals_a_plain_fit(spark):
    """The whole query against numpy: features, normal equations and the isotonic steps."""
    import zlib

    import numpy as np

    documents, labels, _ = corpus()
    docs = spark.createDataFrame([(i, d[1]) for i, d in enumerate(documents)], "doc_id long, text string")
    known = {d: q for d, q, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    got = {r.doc_id: r for r in qc.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    x = np.array([qc.statistics(d[1]) for d in documents])
    fit, y = x[sorted(known)], np.array([known[i] for i in sorted(known)], dtype=float)
    mean, sd = fit.mean(axis=0), fit.std(axis=0)
    rng = np.random.default_rng(11)
    directions, phases = rng.normal(0, 1 / 3, (x.shape[1], 256)), rng.uniform(0, 2 * np.pi, 256)
    z = lambda a: np.hstack([np.cos(np.clip((a - mean) / np.where(sd > 1e-9, sd, 1), -8, 8) @ directions + phases) * np.sqrt(2 / 256), np.ones((len(a), 1))])
    w = np.linalg.solve(z(fit).T @ z(fit) + 1e-3 * len(y) * np.diag([*np.full(256, 1 / 256), 1e-9]), z(fit).T @ y)
    at = np.clip(np.floor((z(fit) @ w + 1) / 3 * 1000), 0, 999).astype(int)
    bins = sorted(set(at.tolist()))
    ones, n = [y[at == b].sum() for b in bins], [(at == b).sum() for b in bins]
    steps = [max(min(sum(ones[j : k + 1]) / sum(n[j : k + 1]) for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    raw = z(x) @ w
    score = 0.999 * np.interp(raw, [(b + 0.5) / 1000 * 3 - 1 for b in bins], steps) + 1e-3 * np.clip((raw + 1) / 3, 0, 1)
    for i in range(len(documents)):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert abs(got[i].score - score[i]) < 2e-3, i
        assert got[i].predicted == int(got[i].score >= 0.5)


def test_only_the_result_stays_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables_module, "shared_dir", lambda _: str(tmp_path))
    rows = cp.run(spark, "/root/testdata/sf0.001")
    assert [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["stage", "4"]]
    assert rows.count() > 0
