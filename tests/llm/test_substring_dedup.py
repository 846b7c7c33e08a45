"""Removal against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

from panelspark.llm import substring_dedup as sd
from panelspark.llm.word_hashes import run_hashes, word_hashes


def plain(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "漢字", "\x1c", "\xa0", "x" * 300]
    shared = " ".join(rng.choice(vocabulary) for _ in range(12))
    out = [None, "", " \t\n", "one two", shared, shared, shared + " tail", "a " * 30, "b b b b b b b b b b"]
    for _ in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        if rng.random() < 0.4:
            t.insert(rng.randrange(len(t) + 1), shared)
        out.append(rng.choice([" ", "\n", "  ", "\r\n"]).join(t))
    return out


def test_removal_equals_plain(spark, monkeypatch):
    rows = [(None if i == 5 else i // 2, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string").repartition(5)
    for window in (5, 9):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.dedup_report(docs, window).collect())
        assert got == Counter((d, *p) for (d, *_), p in zip(rows, plain([t for _, t, _ in rows], window), strict=True))


def test_small_flushes_and_full_sketches_lose_nothing(monkeypatch):
    """All windows in a few groups and many flushes, through the same functions without Spark."""
    window, docs = 5, texts()[1:]
    held = []
    for i, t in enumerate(docs):
        w = word_hashes(t.encode())
        h = run_hashes(w, window)
        if len(h):
            held.append((i, 7, h, (run_hashes(w, window, 1) >> np.uint64(32)).astype(np.uint32), np.arange(len(h), dtype=np.int32)))
    import pandas as pd

    entries = [e for k in range(0, len(held), 7) for e in sd._representatives(held[k : k + 7], 2)]
    frame = pd.DataFrame(entries, columns=["group", "keys", "hashes", "checks", "places", "more"])
    found = Counter()
    for _, part in frame.groupby("group"):
        for r in sd._repeated(part).itertuples():
            found.update((r.id_hash, int(p)) for p in np.frombuffer(r.places, dtype=np.int32))
    words = [t.encode().split() for t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    want = Counter((d, i) for d, w in enumerate(words) for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1)
    assert found == want


def test_slices_lose_nothing(spark, monkeypatch):
    """A sketch cut into slices, through Spark."""
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sd.sketch_size(10**9, 35, 1 << 24) == (24, 32)
    monkeypatch.setattr(sd, "sketch_size", lambda *_: (22, 4))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.dedup_report(docs, 9).collect())
    assert got == Counter((d, *p) for (d, _), p in zip(rows, plain([t for _, t in rows], 9), strict=True))


def test_minimizers_of_equal_windows_are_equal(monkeypatch):
    monkeypatch.setattr(sd, "PLACES_AT_ONCE", 64)
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 40, dtype=np.uint64)[rng.integers(0, 40, 500)]
    words[300:400] = words[50:150]
    words[420:480] = words[420]
    places, hashes, own = sd.minimizers(words, 9)
    assert len(own) == 492 and (hashes == run_hashes(words, 4)[places]).all()
    offset = places[own] - np.arange(492)
    assert offset.min() >= 0 and offset.max() <= 5
    assert (offset[300:392] == offset[50:142]).all() and (offset[420:472] == 0).all()
    assert all(len(x) == 0 for x in sd.minimizers(words[:8], 9))


def test_very_long_text(spark):
    """A text of two million words that holds one passage twice, and another of a short text."""
    long = [f"w{i}" for i in range(2_000_000)]
    long[1_500_000:1_500_060] = long[100:160]
    rows = [(1, " ".join(long)), (2, " ".join([*long[5000:5040], "tail"])), (3, " ".join(long[:34]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2_000_000, 160), 2: (41, 40), 3: (34, 0)}


def test_other_columns_and_untouched_texts_stay(spark):
    docs = spark.createDataFrame([(1, "a  b", 5), (2, "p q r s t", 6), (3, "x p q r s t", 7)], "doc_id long, text string, places int")
    got = {(r.doc_id, r.text, r.places) for r in sd.without_repeats(docs, 5).collect()}
    assert got == {(1, "a  b", 5), (2, "", 6), (3, "x", 7)}
    assert sd.without_repeats(docs.limit(0), 5).collect() == []


def test_gaps_and_words_in_pieces():
    cells = np.array([0, 0, 3, 254, 255, 256, 1000, 70_000], dtype=np.uint64)
    assert (sd.decode_gaps(sd.encode_gaps(cells)) == cells.astype(np.int64)).all()
    text = ("é" * 400 + " ab\n" + "z" * 90 + "  c ") * 20
    assert (word_hashes(text.encode(), 64) == word_hashes(text.encode())).all()
    assert len(word_hashes(text.encode(), 64)) == len(text.split())


def test_places_of_equal_rows_grow_with_the_rows(spark):
    """Thousands of equal rows: as many lists of places for each as for two of them."""
    rng = random.Random(21)
    text = " ".join(f"e{rng.randrange(10**6)}" for _ in range(400))
    for copies in (2, 2000):
        docs = spark.createDataFrame([(1, text)] * copies + [(2, "x " * 40), (3, "other words")], "doc_id long, text string").repartition(4)
        _, touched = sd.found_repeats(docs, 35, 1 << 29)
        sizes = touched.filter("row.doc_id = 1").selectExpr("coalesce(size(places), 0) AS lists", "coalesce(aggregate(places, 0, (s, p) -> s + length(p)), 0) AS bytes").distinct().collect()
        assert len(sizes) == 1 and sizes[0]["lists"] <= 64 and sizes[0]["bytes"] <= 2 * 4 * 400
        got = {(r.doc_id, r.n_words, r.n_removed) for r in sd.dedup_report(docs, 35).collect()}
        assert got == {(1, 400, 400), (2, 40, 40), (3, 2, 0)}
