"""Fingerprints, thresholds and components against plain computations."""

import random
import re
from itertools import product

import numpy as np
import xxhash

from panelspark.llm import simhash_dedup as sh


def plain_fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    nodes = {}
    for d, f in rows:
        nodes.setdefault(f, []).append(d)
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(nodes)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for f, ds in nodes.items():
        known = [d for d in [*ds, low.get(find(f))] if d is not None]
        low[find(f)] = min(known, default=None)
    return {(d, f"{f:016x}", low[find(f)]) for d, f in rows}


def test_fingerprints():
    for t in (None, "", " \n", "A b", "x", "É é A\x0bb c  d\x1ce", "the cat sat on the mat " * 50):
        assert sh.fingerprint(t) % (1 << 64) == plain_fingerprint(t)
    assert sh.fingerprint("a b c d e f g", block=2) == sh.fingerprint("a b c d e f g")


def test_components_equal_plain(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(300)) for _ in range(8)]
    texts = [None, "", "", "same text here"] + ["same TEXT here"] * 3
    for i in range(150):
        words = base[i % 3 if i % 2 else i % 8].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice("abcxyz")
        texts.append(" ".join(words))
    rows = [(None if i == 2 else 1000 - i, t) for i, t in enumerate(texts)] + [(1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS component_id")
    want = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    for bucket in (3, 24):
        got = sh.group_documents(docs, bucket=bucket).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == want
    kept = {r.doc_id for r in sh.one_of_each(docs).collect()}
    assert kept == {c for _, _, c in want}


def test_random_fingerprints_link_exactly(spark):
    rng = random.Random(9)
    values = {0, 1, 3, 7, (1 << 64) - 1, 1 << 63}
    for _ in range(120):
        x = rng.getrandbits(64)
        values |= {x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    got = {frozenset((r.a, r.b)) for r in sh.links(frame).collect()}
    assert got == want
    assert {frozenset((r.a, r.b)) for r in sh.links(frame, parts=2).collect()} == want


def test_thresholds_are_the_cheapest():
    costs = [[5.0, 9.0, 12.0], [1.0, 2.0, 40.0], [7.0, 8.0, 9.0]]
    price = lambda ts: sum(c[t] if t >= 0 else 0 for c, t in zip(costs, ts))
    best = sh.best_thresholds(costs, 0)
    assert sum(best) == 0 and price(best) == min(price(t) for t in product(range(-1, 3), repeat=3) if sum(t) == 0)
    ones = np.full(64, 0.5)
    parts = sh.correlated_parts(np.eye(64), 3)
    assert sorted(sum(parts, [])) == list(range(64)) and len(sh.expected_candidates(ones, parts[0], 4.0, 2)) == 3


def test_empty_table(spark):
    assert sh.group_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
