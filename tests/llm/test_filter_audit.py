"""The audit against filters that are really applied, one after another."""

from collections import Counter
from itertools import permutations
import re

import duckdb

from panelspark.llm import filter_audit, queries
from tests.test_entry import rows_of

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(docs):
    """For each document the letters of the filters that it fails."""
    out = []
    for doc_id, text, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        bad = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        bad += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        bad += "E" * any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)
        out.append(set(bad))
    return out


def applied(docs, labels):
    """The report by applying all orders to all documents."""
    bad, good, toxic = failing(docs), {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        left = list(range(len(docs)))
        for step, letter in enumerate(order, 1):
            gone = [d for d in left if letter in bad[d]]
            left = [d for d in left if letter not in bad[d]]
            for part in {p or "" for _, _, p in docs}:
                own = [d for d, (_, _, p) in enumerate(docs) if (p or "") == part]
                here = [d for d in gone if (docs[d][2] or "") == part]
                shapley[part, letter] += len(here)
                rows[part, order, step] = [
                    sum(d in left for d in own), len(here), sum(letter in bad[d] for d in own if d not in left and d not in gone), sum(bad[d] == {letter} for d in own),
                    sum(docs[d][0] in good for d in here), sum(docs[d][0] in toxic for d in here),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def found(spark, docs, labels):
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS digest", "0 AS n")
    rows = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def documents():
    plain = " ".join(f"w{i}" for i in range(250))
    few, dull, loud = "a b c", " ".join(["same", "words"] * 200), " ".join(f"W{i}X" for i in range(250))
    odd = plain + " #"
    texts = [plain, few, dull, loud, odd, plain, few, loud, None, "", "  ", dull + " #", few + " AB &", " ", plain, plain]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts)]
    return [*docs, (15, plain, ""), (None, plain, "en"), (None, None, None), (3, "x" * 300_000, "en")]


def test_equals_applied_filters(spark):
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (5, 1, 0), (5, 0, 1), (7, None, 1), (14, 1, None), (None, 1, 1), (3, 1, 0)]
    assert found(spark, documents(), labels) == applied(documents(), labels)


def test_hot_keys_change_nothing(spark, monkeypatch):
    labels = [(i, i % 2, 1) for i in range(0, 60, 3)]
    docs = [(i, "same text" if i % 3 else f"text {i}", "en") for i in range(60)] + [(7, f"other {i}", "de") for i in range(30)]
    wanted = found(spark, docs, labels)
    monkeypatch.setattr(filter_audit, "HOT_ROWS", 5)
    assert found(spark, docs, labels) == wanted == applied(docs, labels)


def test_empty_table(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}


def test_query_equals_oracle(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    own, wanted = queries.op12_filter_audit(spark, SMALL), db.execute(filter_audit.oracle())
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(own.columns)
    assert rows_of(own.columns, own.collect()) == rows_of(names, wanted.fetchall())
