"""Benchmark decontamination by winnowing.

Words are runs of letters and digits (any character above ASCII counts as a letter),
A-Z lower-cased. A document word is hit where a window of ``window`` consecutive words
of a benchmark item stands; an item of fewer words is one window.

Each text is hashed in runs of ``gram`` words, and every ``window`` has as its
fingerprint the smallest hash within it. Equal windows have equal fingerprints, so
every shared span of ``window`` words or more meets in the join of fingerprints (the
winnowing guarantee). Neighbouring windows mostly share theirs, so a document joins
with one entry, the words around it attached, for some five of its windows. Joined
entries are extended to all windows they stand for, which are compared as text. Items
shorter than a window, if there are any, are looked for among the document's runs of
just their length.

Everything is in built-in functions. The benchmark's fingerprints are broadcast only up
to ``broadcast_rows`` of them, and each document is read once. Beyond that, entries are
shuffled without their words, to find the documents that share a fingerprint, and only
these are read again and joined with their words; a passage in a third of all documents is a
skewed key that Spark splits, since the benchmark's side holds each fingerprint once.

A null text has no words; rows are judged each, also repeated ones; benchmark rows
without words or id are not looked for; empty tables are allowed; columns other than
doc_id, item_id and text are not read by :func:`find_contamination`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import NON_WORD, ascii_lower, row_hashes, text_or_empty, without_rows, written


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.array_remove(F.split(F.regexp_replace(ascii_lower(text), NON_WORD, " "), " "), "")


def gram_hashes(words: Column, gram: int) -> Column:
    """The hash of each run of ``gram`` words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - gram), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(gram))))


def with_minima(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Add ``minima``: each window's fingerprint, in order (null for texts shorter than a window)."""
    width = window - gram + 1
    long = F.size("words") >= window
    return texts.withColumn("hashes", F.when(long, gram_hashes(F.col("words"), gram))).withColumn(
        "minima", F.transform(F.sequence(F.lit(1), F.size("hashes") - width + 1), lambda i: F.array_min(F.slice("hashes", i, width)))
    )


def joined(words: Column, start: Column, length: Column | int) -> Column:
    """The text of ``length`` words from ``start`` (from 0)."""
    return F.array_join(F.slice(words, start + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """item, length, fingerprint and text of each window of each item."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words_of(text_or_empty()).alias("words"))
    long = with_minima(items, window, gram).filter(F.size("words") >= window)
    windows = long.select("item", "words", F.posexplode("minima").alias("start", "fingerprint")).select(
        "item", F.lit(window).alias("length"), "fingerprint", joined(F.col("words"), F.col("start"), window).alias("text")
    )
    short = items.filter(F.size("words").between(1, window - 1)).select(
        "item", F.size("words").alias("length"), F.xxhash64("words").alias("fingerprint"), F.array_join("words", " ").alias("text")
    )
    return windows.unionByName(short).distinct()


def document_entries(docs: DataFrame, window: int, gram: int, short_lengths: list[int], with_words: bool = True) -> DataFrame:
    """All columns of ``docs`` (but the text), row, n_words and a row for each entry: at, length, fingerprint, start,
    and the words of the windows that it stands for. Texts without entries have one of nulls."""
    others = [c for c in docs.columns if c != "text"]
    read = docs.select(*others, words_of(text_or_empty()).alias("words"), F.monotonically_increasing_id().alias("row"))
    read = with_minima(read, window, gram)
    # the first of each run of windows with one fingerprint, and the run's end
    starts = F.filter(
        F.sequence(F.lit(0), F.size("minima") - 1), lambda i: (i == 0) | (F.get("minima", i) != F.get("minima", i - 1))
    )
    read = read.withColumn("starts", F.when(F.size("minima") > 0, starts))
    entry = lambda length, fingerprint, start, words: F.struct(
        F.lit(length).alias("length"), fingerprint.alias("fingerprint"), start.alias("start"), *([words.alias("context")] if with_words else [])
    )
    entries = [
        F.coalesce(
            F.transform(
                "starts",
                lambda s, i: entry(
                    window, F.get("minima", s), s, F.slice("words", s + 1, F.coalesce(F.get("starts", i + 1), F.size("minima")) - s + window - 1)
                ),
            ),
            F.array(),
        )
    ]

    def runs(n: int) -> Column:
        run = lambda i: F.slice("words", i + 1, n)
        return F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: entry(n, F.xxhash64(run(i)), i, run(i)))

    entries += [F.when(F.size("words") >= n, runs(n)).otherwise(F.array()) for n in short_lengths]
    return read.select(
        *others, "row", F.size("words").cast("long").alias("n_words"),
        F.posexplode_outer(F.concat(*entries) if len(entries) > 1 else entries[0]).alias("at", "entry"),
    ).select(*others, "row", "n_words", "at", "entry.*")


def covered_words(spans: Column) -> Column:
    """How many words an array of (start, end) covers."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step, lambda a: a["n"]).cast("long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    windows = written(benchmark_windows(benchmark, window, gram), "benchmark-windows")
    # lengths below a window: a handful of numbers at most
    short = sorted(r["length"] for r in windows.select("length").distinct().collect() if r["length"] < window)
    fingerprints = windows.select("length", "fingerprint").distinct().withColumn("known", F.lit(True))
    if fingerprints.count() <= broadcast_rows:
        return judged(docs.select("doc_id", "text"), windows, F.broadcast(fingerprints), short, window, gram)
    # too many to broadcast: entries without their words find the documents that share any, and
    # words are read again for these alone
    keys = ["id_hash", "text_hash"]
    keyed = docs.select("doc_id", "text", *row_hashes())
    met = document_entries(keyed.drop("doc_id"), window, gram, short, with_words=False).filter("at is not null")
    met = written(met.join(fingerprints, ["length", "fingerprint"]).select(*keys).distinct(), "contamination-keys")
    found = judged(keyed.join(met, keys, "left_semi").select("doc_id", "text"), windows, fingerprints, short, window, gram)
    rest = keyed.join(met, keys, "left_anti").select(
        "doc_id", F.size(words_of(text_or_empty())).cast("long").alias("n_words"), *(F.lit(0).cast("long").alias(c) for c in ("n_hit", "n_items")),
        F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"),
    )
    return found.unionByName(rest)


def judged(docs: DataFrame, windows: DataFrame, fingerprints: DataFrame, short: list[int], window: int, gram: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) against the benchmark's windows, by entries with their words."""
    entries = document_entries(docs, window, gram, short).join(fingerprints, ["length", "fingerprint"], "left")
    kept = written(
        entries.filter(F.col("known") | F.col("at").isNull() | (F.col("at") == 0)).select(
            "row", "doc_id", "n_words", "length", "fingerprint", "start", F.when(F.col("known"), F.col("context")).alias("context"), "at"
        ),
        "contamination-entries",
    )
    shift = F.sequence(F.lit(0), F.size("context") - F.col("length"))
    hits = (
        kept.filter(F.col("context").isNotNull())
        .select("row", "length", "start", "context", F.explode(shift).alias("shift"))
        .select("row", "length", (F.col("start") + F.col("shift")).alias("start"), joined(F.col("context"), F.col("shift"), F.col("length")).alias("text"))
    )
    span = F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("end"))
    places = hits.join(windows.select("length", "text").distinct(), ["length", "text"], "left_semi")
    n_hit = places.groupBy("row").agg(covered_words(F.collect_set(span)).alias("n_hit"))
    items = (
        hits.select("row", "length", "text").distinct()
        .join(windows.select("length", "text", "item"), ["length", "text"])
        .groupBy("row").agg(F.collect_set("item").alias("items"))
    )
    rows = kept.filter(F.col("at").isNull() | (F.col("at") == 0)).select("row", "doc_id", "n_words")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return (
        rows.join(n_hit, "row", "left")
        .join(items, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size(found).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(found), ","), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 4) -> DataFrame:
    """The rows of ``docs`` whose text isn't contaminated, whatever other rows have their doc_id."""
    keyed = docs.select(F.struct(*row_hashes()).alias("doc_id"), "text")
    return without_rows(docs, find_contamination(keyed, benchmark, window, gram).filter("contaminated").select("doc_id.*"))


def oracle(window: int = 13) -> str:
    """The same in DuckDB SQL, joining all windows."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {words} AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words} AS words FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(words), {window}) AS n, array_to_string(words[i : i + least(len(words), {window}) - 1], ' ') AS gram
  FROM (SELECT item, words, unnest(range(1, len(words) - least(len(words), {window}) + 2)) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT id, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(words) >= n)),
hit AS (SELECT id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
w AS (SELECT id, count(DISTINCT spot) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS spot FROM hit) GROUP BY id),
x AS (SELECT id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, len(coalesce(items, []))::BIGINT AS n_items,
       sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words)) AS contaminated
FROM d LEFT JOIN w USING (id) LEFT JOIN x USING (id)
"""
