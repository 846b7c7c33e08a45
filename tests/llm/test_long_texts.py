"""Texts of megabytes, beside short ones, through the operators that work on whole texts."""

import random
import re

import pytest

from panelspark.llm import decontamination, filter_audit, hilbert_shards, license_scan, near_copies, quality_classifier, quality_rules, simhash_dedup

WORDS = 400_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(5000)]
    words = [rng.choice(vocabulary) for _ in range(WORDS)]
    words[WORDS - 10 : WORDS - 6] = ["under", "the", "MIT", "License"]
    changed = list(words)
    for at in range(0, WORDS, 1000):
        changed[at] = "other"
    return {0: " ".join(words), 1: " ".join(changed), 2: "x" * 2_000_000, 3: "short text. " * 30, 4: None, 5: "", 6: "\n" * 1_000_000}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i}") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_shards(docs, texts):
    rows = hilbert_shards.shard_documents(docs, shards=3).collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: 16 + len((t or "").encode()) for i, t in texts.items()}


def test_licenses(docs):
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert found[0].n_words == WORDS and found[0].first_word == found[0].last_word == WORDS - 10 and found[0].base_labels == "mit"
    assert found[2].n_words == 1 and found[2].n_base == found[6].n_words == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, labels).collect())


def test_rules(docs, texts):
    found = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert found[0].n_words == WORDS and found[0].word_chars == len(texts[0].replace(" ", ""))
    assert found[2].word_chars == 2_000_000 and found[6].n_words == 0 and found[3].n_repeat_words == 60


def test_fingerprints(docs, texts):
    found = {r.doc_id: r.fingerprint for r in simhash_dedup.group_documents(docs, shingle=3, distance=2).collect()}
    assert found == {i: f"{simhash_dedup.fingerprint(t) & (1 << 64) - 1:016x}" for i, t in texts.items()}


def test_contamination(spark, docs, texts):
    item = " ".join(texts[0].split()[200_000:200_020])
    bench = spark.createDataFrame([("a", item), ("b", "not there at all " * 5)], "item_id string, text string")
    found = {r.doc_id: r for r in decontamination.find_contamination(docs, bench).collect()}
    assert (found[0].n_words, found[0].n_items) == (WORDS, 1) and found[0].n_hit >= 20 and not found[0].contaminated
    assert found[2].n_words == 1 and found[2].n_hit == 0


def test_near_copies(docs):
    found = dict(map(tuple, near_copies.group_near_copies(docs).collect()))
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 4}


def test_audit(spark, docs, texts):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    (first,) = [r for r in filter_audit.audit(docs, labels).collect() if (r.filter_order, r.step) == ("ABCDE", 1)]
    assert first.removed == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) < 200 for t in texts.values())
