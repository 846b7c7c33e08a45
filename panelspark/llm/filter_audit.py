"""What each of several filters removes from a corpus, in every order in which they could be applied.

1. Native expressions give each document the failures of four filters as bits of a mask. The fifth, that
   an equal text stands under a smaller doc_id, needs the table: rows are counted by
   doc_id, part, mask and a digest of the text, which pre-aggregates equal rows, and a ``groupBy`` of the
   digests supplies the smallest doc_id of each text.
2. Labels and smallest doc_ids meet the rows in joins of which the hot keys are taken out: those that more than
   1 / ``HOT_SHARE`` of all rows share are fewer than ``HOT_SHARE``, so they are broadcast, and no
   task holds more than that share of one key. Only digests and numbers are shuffled, not texts.
3. Rows are counted by part and mask: at most 32 cells a part, whatever the size of the corpus.
   All orders and their steps are then worked out from the cells alone.

A null text is empty, a null part an empty string. A null doc_id fails no repeat and has no
label; it isn't anyone's smaller doc_id either. Rows of one doc_id are documents of their own; a doc_id with
several labels has those that any of them gives. Very long texts are worked on in
place; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import UPPER, text_or_empty, written

FILTERS = "ABCDE"
#: Keys with more than rows / HOT_SHARE rows are hot, but none with fewer than HOT_ROWS.
HOT_SHARE, HOT_ROWS = 1000, 100_000


def failures(text: Column) -> Column:
    """The failures of one text alone, as bits: 1 few words, 2 few distinct words, 4 many capitals, 8 symbols."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    conditions = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def hot_join(left: DataFrame, right: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """Left join on ``key``, unique in ``right``; ``held`` has the key and ``n``, its rows in ``left``, for all keys.

    Hot keys are fewer than ``HOT_SHARE``: their rows stay where they are, beside a broadcast table."""
    least = max(HOT_ROWS, (held.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = written(held.filter((F.col("n") > least) & F.col(key).isNotNull()).select(key), f"hot-{key}")
    if hot.isEmpty():
        return left.join(right, key, "left")
    beside = F.broadcast(hot.join(right, key, "left"))
    return left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left").unionByName(left.join(beside, key))


def masked_rows(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, digest, mask (of the text alone) and n, the number of such rows; as written."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("mask"))
    return written(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masked-rows")


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask (five bits), n, good and toxic: the numbers of documents, and of those with a label."""
    rows = masked_rows(docs, part)
    texts = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("n").alias("n")), "first-ids")
    again = texts.filter("n > 1").select("digest", "first_id")
    found = hot_join(rows, again, "digest", texts.select("digest", "n"))
    mask = F.col("mask") + F.when(F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)), 16).otherwise(0)
    found = written(found.groupBy("doc_id", "part", mask.alias("mask")).agg(F.sum("n").alias("n")), "full-masks")
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marks = marks.filter("doc_id IS NOT NULL AND good + toxic > 0")
    # a null doc_id has no label: such rows need no join
    found_rows, others = found.filter("doc_id IS NOT NULL"), found.filter("doc_id IS NULL").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    held = found_rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    labelled = hot_join(found_rows, marks, "doc_id", held).unionByName(others)
    sums = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))]
    return labelled.groupBy("part", "mask").agg(*sums)


def order_steps() -> Column:
    """An array of filter_order, step, own (the step's filter as a bit) and before (those of earlier steps)."""
    steps = []
    for order in permutations(FILTERS):
        for at, letter in enumerate(order):
            before = sum(1 << FILTERS.index(x) for x in order[:at])
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(at + 1).alias("step"), F.lit(1 << FILTERS.index(letter)).alias("own"), F.lit(before).alias("before")))
    return F.array(*steps)


def interactions(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for every order and step."""
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = by_part.select("part", "cells", F.explode(order_steps()).alias("s")).select("part", "cells", "s.*")

    def total(value, holds) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(holds(c["mask"]), value(c)).otherwise(0).cast("long"))

    own, before = F.col("own"), F.col("before")

    def fails(mask: Column, bits: Column) -> Column:
        return mask.bitwiseAND(bits) != 0

    def removed(mask: Column) -> Column:
        return fails(mask, own) & ~fails(mask, before)

    # of the orders of a document's failing filters, each of them comes first in an equal share
    share = F.lit(factorial(len(FILTERS)))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: c["n"], lambda m: ~fails(m, own.bitwiseOR(before))).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda m: fails(m, own) & fails(m, before)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(lambda c: c["n"] * F.floor(share / F.bit_count(c["mask"])), lambda m: fails(m, own)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The result of :func:`interactions` for all documents."""
    return interactions(mask_cells(docs, labels, part))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT part, doc_id,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
st AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, step::INT AS step,
  sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM c, st GROUP BY part, filter_order, step
"""


def oracle() -> str:
    """DuckDB SQL for the same rows."""
    return ORACLE_SQL
