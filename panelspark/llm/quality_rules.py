"""Quality rules and the divergence of a document's histograms from its language's.

Base: counts over the words of the whole text, and a verdict on too few words or too
many repeated ones. Method: the shares of character classes and of common words are
compared with those of all documents of the same language by the Jensen-Shannon
distance (base 2, 0 to 1); a document fails where a distance exceeds its limit, but
only from a minimum length on, below which shares are noise.

Everything is in built-in functions. Each text is read twice, for the commonest words and
for its counts; these, a few dozen numbers, are written to the shared folder, from which
references and distances come.
Repeated three-word windows are found inside the row: the windows' hashes are sorted
with their places packed in, and neighbours of equal hash are compared as text.

A null text counts as empty, a null language is a language of its own, repeated rows
are judged each and count each, an empty table gives an empty result, and columns
other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE, text_or_empty, written

#: Commonest words of a language that make its histogram.
COMMON = 10
#: Character classes by Java pattern; what is left is a class of its own.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "high": r"\x80-\x{10FFFF}", "symbol": "#*$%&|<>"}
PLACE_BITS = 31


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, n: Column) -> Column:
    """Words in three-word windows that the array holds twice or more."""
    place = F.lit((1 << PLACE_BITS) - 1)

    def hash_and_place(i: Column) -> Column:
        mixed = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(F.shiftrightunsigned(mixed, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))

    def alike(all_: Column, of: Callable[[Column], Column]) -> Column:
        same = lambda x, y: F.coalesce(of(x) == of(y), F.lit(False))
        return F.filter(all_, lambda x, i: same(x, F.get(all_, i - 1)) | same(x, F.get(all_, i + 1)))

    def window_text(packed: Column) -> Column:
        p = packed.bitwiseAND(place).cast("int")
        return F.struct(F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("text"), p.alias("place"))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    hashes = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), hash_and_place))
    maybe = bound(hashes, lambda h: alike(h, lambda x: F.shiftrightunsigned(x, PLACE_BITS)))
    windows = bound(F.sort_array(F.transform(maybe, window_text)), lambda w: alike(w, lambda x: x["text"]))
    counted = bound(F.sort_array(F.transform(windows, lambda w: w["place"])), covered)
    return F.when(n >= 3, counted).otherwise(F.lit(0)).cast("long")


def common_words(docs: DataFrame, n: int) -> DataFrame:
    """of (a language) and common, its ``n`` commonest words over all documents (the first in
    order, of equal ones); a row for each language."""
    words = docs.select("lang", F.explode(F.split(text_or_empty(), SPACE)).alias("word")).filter("word <> ''")
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("held"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("held"), "word"))
    top = counts.withColumn("nth", nth).filter(F.col("nth") <= n)
    return top.groupBy(F.col("lang").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"]).alias("common"))


def document_counts(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, lang, the base counts and the two histograms (arrays of counts) of every row."""
    common = written(common_words(docs, n), "common-words")  # a row for each language
    read = docs.select("doc_id", "lang", text_or_empty().alias("text")).withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    read = read.join(F.broadcast(common), F.col("lang").eqNullSafe(F.col("of")), "left")
    kept = lambda pattern: F.length(F.regexp_replace("text", f"[^{pattern}]+", "")).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # only the common words of the document's language, then each of them
    reduced = lambda use: bound(F.filter("words", lambda w: F.array_contains("common", w)), use)
    each = reduced(lambda found: F.transform("common", lambda w: (F.size(found) - F.size(F.array_remove(found, w))).cast("long")))
    read = read.select(
        "doc_id",
        "lang",
        "words",
        F.length("text").cast("long").alias("chars"),
        F.size("words").alias("n"),
        F.array(*(kept(p) for p in CLASSES.values())).alias("classes"),
        F.coalesce(each, F.array().cast("array<bigint>")).alias("commons"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    space, symbol = list(CLASSES).index("space"), list(CLASSES).index("symbol")
    rest = lambda total, parts: F.concat(parts, F.array(total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b)))
    return read.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        (F.col("chars") - F.col("classes")[space]).alias("word_chars"),
        F.col("classes")[symbol].alias("n_symbols"),
        "n_dup_lines",
        repeated_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
        "chars",
        rest(F.col("chars"), F.col("classes")).alias("char_counts"),
        rest(F.col("n").cast("long"), F.col("commons")).alias("word_counts"),
    )


def jensen_shannon(counts: Column, reference: Column) -> Column:
    """The distance between two arrays of counts; null where one has no count."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    shares = F.zip_with(counts, reference, lambda p, q: F.struct((p / total(counts)).alias("p"), (q / total(reference)).alias("q")))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    half = F.aggregate(shares, F.lit(0.0), lambda a, s: a + term(s["p"], (s["p"] + s["q"]) / 2) + term(s["q"], (s["p"] + s["q"]) / 2))
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(half / 2, F.lit(0.0))))


def language_references(counts: DataFrame, n: int) -> DataFrame:
    """lang and both histograms summed over all its documents; a row for each language."""
    added = lambda name, size: F.array_compact(F.array(*(F.sum(F.try_element_at(F.col(name), F.lit(i + 1))).cast("double") for i in range(size))))
    return counts.groupBy("lang").agg(added("char_counts", len(CLASSES) + 1).alias("char_reference"), added("word_counts", n + 1).alias("word_reference"))


def judge(
    docs: DataFrame, char_limit: float = 0.3, word_limit: float = 0.2, least_chars: int = 500, least_words: int = 200, n_common: int = COMMON
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and the two distances (null below the minimum lengths)."""
    counts = written(document_counts(docs, n_common), "document-counts")
    references = F.broadcast(language_references(counts, n_common))  # a row for each language
    far = counts.join(references.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
    far = far.withColumn("char_distance", F.when(F.col("chars") >= least_chars, jensen_shannon(F.col("char_counts"), F.col("char_reference"))))
    far = far.withColumn("word_distance", F.when(F.col("n_words") >= least_words, jensen_shannon(F.col("word_counts"), F.col("word_reference"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    diverges = F.coalesce(F.col("char_distance") > char_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return far.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~diverges).alias("kept"),
        F.round("char_distance", 6).alias("char_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )


def oracle(char_limit: float = 0.3, word_limit: float = 0.2, least_chars: int = 500, least_words: int = 200, n_common: int = COMMON) -> str:
    """The same in DuckDB SQL, counting windows with a plain GROUP BY."""
    word = r"'[^\x20\x09-\x0D]+'"
    kept = lambda pattern: f"length(regexp_replace(text, '[^{pattern}]', '', 'g'))"
    classes = ", ".join(kept(p) for p in CLASSES.values())
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"

    def distance(counts: str, reference: str) -> str:
        p, q = f"x / list_sum({counts})", f"{reference}[i] / list_sum({reference})"
        term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END"
        total = f"list_sum(list_transform({counts}, lambda x, i: {term(p)} + {term(q)}))"
        return f"sqrt(greatest({total} / 2, 0))"

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {word}) AS words
  FROM documents),
top AS (
  SELECT lang AS top_lang, list(word ORDER BY held DESC, word) AS common FROM (
    SELECT lang, word, count(*) AS held FROM (SELECT lang, unnest(words) AS word FROM d) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= {n_common}) GROUP BY lang),
w AS (
  SELECT id, i, list_aggregate(words[i : i + 2], 'string_agg', ' ') AS gram
  FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
r AS (
  SELECT id, count(DISTINCT spot) AS n FROM (
    SELECT id, unnest(range(i, i + 3)) AS spot FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS held FROM w) WHERE held > 1)
  GROUP BY id),
l AS (
  SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, {word}) GROUP BY id),
c AS (
  SELECT d.*, len(words) AS n_words, length(text) AS chars, [{classes}] AS part,
         coalesce(list_transform(top.common, lambda x: len(list_filter(words, lambda y: y = x))), []) AS common, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_dup_lines
  FROM d LEFT JOIN top ON lang IS NOT DISTINCT FROM top_lang LEFT JOIN r USING (id) LEFT JOIN l USING (id)),
h AS (
  SELECT *, list_append(part, chars - list_sum(part)::BIGINT) AS cc, list_append(common, n_words - coalesce(list_sum(common), 0)::BIGINT) AS wc FROM c),
f AS (
  SELECT lang AS of_lang, {sums("cc", len(CLASSES) + 1)} AS cr, list_filter({sums("wc", n_common + 1)}, lambda x: x IS NOT NULL) AS wr FROM h GROUP BY lang),
j AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         CASE WHEN chars >= {least_chars} THEN {distance("cc", "cr")} END AS cd,
         CASE WHEN n_words >= {least_words} THEN {distance("wc", "wr")} END AS wd
  FROM h JOIN f ON lang IS NOT DISTINCT FROM of_lang)
SELECT doc_id, n_words::BIGINT AS n_words, (chars - part[{list(CLASSES).index("space") + 1}])::BIGINT AS word_chars,
       part[{list(CLASSES).index("symbol") + 1}]::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce(cd > {char_limit}, false) AND NOT coalesce(wd > {word_limit}, false)) AS kept,
       round(cd, 6)::DOUBLE AS char_distance, round(wd, 6)::DOUBLE AS word_distance
FROM j
"""
