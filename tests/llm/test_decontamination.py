"""Hits against a plain search of every window."""

import hashlib
import random
import re
from collections import Counter

from panelspark.llm import decontamination as dc


def words_of(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain(text, items, window=13):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        n = min(window, len(own))
        if item is None or not n:
            continue
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def cases():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "x"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = line(16)
    items = [(i, line(rng.randrange(13, 40))) for i in range(8)] + [(9, common + " a b"), (10, common + " c"), (11, "one two three"), (12, "a a a a a"), (13, ""), (14, None), (15, "z")]
    items += [(9, common + " a b"), (None, line(20)), (16, "k " * 40)]
    docs = [None, "", "One, TWO; three!", "a a a a a a a", "zz z-z", "k " * 13, "k " * 100, common, line(5) + " " + common + " " + line(400)]
    for _ in range(40):
        words = line(rng.randrange(5, 200)).split()
        own = words_of(rng.choice(items)[1])
        cut = rng.randrange(0, max(1, len(own)))
        words[rng.randrange(len(words)) :] += own[cut : cut + rng.randrange(10, 30)]
        docs.append(rng.choice([" ", ". ", "\n"]).join(words))
    return items, docs


def test_hits_equal_plain(spark):
    items, docs = cases()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, length string")
    rows = [(None if i == 3 else i // 2, t, 1) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_hit int").repartition(3)
    for limit in (200_000, 0):
        got = Counter(tuple(r) for r in dc.find_contamination(frame, bench, broadcast_rows=limit).collect())
        assert got == Counter((d, *plain(t, items)) for d, t, _ in rows)


def test_stage_keeps_clean_documents(spark):
    items, docs = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(docs)], "doc_id long, text string, _gone string")
    kept = {r.doc_id for r in dc.without_contaminated(frame, bench).collect()}
    assert kept == {i for i, t in enumerate(docs) if not plain(t, items)[-1]}


def test_stage_keeps_clean_rows_under_the_same_id(spark):
    items, docs = cases()
    frame = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(docs)], "doc_id long, text string")
    kept = dc.without_contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter((None if i % 2 else 7, t) for i, t in enumerate(docs) if not plain(t, items)[-1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in dc.find_contamination(docs, none).collect()] == [False]
    assert dc.find_contamination(docs.limit(0), none).collect() == []
