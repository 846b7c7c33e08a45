"""License scan: exact phrases, and an exact set-similarity join with templates.

Words are runs of letters and digits (any character above ASCII counts as a letter),
A-Z lower-cased. Base: the places where a phrase's words stand consecutively.

The join finds every text block that holds at least ``threshold`` of a template's
distinct words. Blocks are windows of words, whatever the line breaks: a template of up to
w words (of ``WIDTHS``) is looked for in the windows of 2 w words that start at every w-th
word, so that a notice of its length lies whole in one of them. Where two templates are alike (one has
``threshold`` of the other's words), a document gets the label of the other only if no block of its
holds a larger share of the one, or as large a share and more words.

Only words that some template has can count, so blocks are reduced to those, in the order
of their frequency over all documents, rarest first. With need = ceil(threshold x template
size), a block can reach a template only if it has at least ``need`` such words (length
filter), if the first |block| - need + 1 of its words and the first |template| - need + 1
of the template's share one (prefix filter), and if what follows the shared word in both is
long enough (positional filter). What is left is verified exactly. Documents that have
too few words of every template are not cut into blocks at all.

A null text counts as empty; repeated rows are scanned each; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import NON_WORD, ascii_lower, text_or_empty, written

#: phrase -> label
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The notices by which licenses are usually granted, the opening parts of their texts (-full), and
#: whole texts of the short licenses (-text). A template's label is its name without that ending.
TEMPLATES = {
    "agpl-3-notice": "licensed under the GNU Affero General Public License version 3",
    "agpl-3-full": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2-full": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-notice": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3-full": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-short-notice": "Released under the MIT License",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
WIDTHS = (8, 16, 32, 64, 128, 256)


def words_of(text: str) -> list[str]:
    """The words of a short text, as the scan sees them."""
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def spaced(text: Column) -> Column:
    """The words of a text, lower-cased, one space between them."""
    return F.trim(F.regexp_replace(ascii_lower(text), NON_WORD, " "))


def count_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and base_found (labels) from ``spaced``."""
    n_words = F.when(F.col("spaced") == "", 0).otherwise(count_spaces(F.col("spaced")) + 1)
    docs = docs.withColumn("n_words", n_words.cast("long"))
    # every word gets a space of its own on both sides, so that adjacent places don't share one
    own = F.concat(F.lit(" "), F.replace("spaced", F.lit(" "), F.lit("  ")), F.lit(" "))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        there = F.contains("spaced", F.lit(phrase))
        needle = f" {phrase.replace(' ', '  ')} "
        count = (F.length(own) - F.length(F.replace(own, F.lit(needle), F.lit("")))) / len(needle)
        before, after = F.substring_index(own, needle, 1), F.substring_index(own, needle, -1)
        found = there & F.contains(own, F.lit(needle))
        counts.append(F.when(found, count.cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(found, (count_spaces(before) / 2).cast("long")))
        lasts.append(F.when(found, F.col("n_words") - (count_spaces(after) / 2).cast("long") - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    alone = len(phrases) == 1
    return docs.select(
        "*",
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        (firsts[0] if alone else F.least(*firsts)).alias("first_word"),
        (lasts[0] if alone else F.greatest(*lasts)).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_found"),
    )


def vocabulary_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by the number of documents that have them, rarest first.

    As many rows as the templates have words reach the driver."""
    seen = docs.select(F.explode(F.array_intersect(F.split("spaced", " "), F.lit(vocabulary))).alias("word"))
    counts = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def label_of(template: str) -> str:
    """The label of a template: its name without ``-notice``, ``-full`` or ``-text``."""
    return re.sub(r"(-short)?-(notice|full|text)$", "", template)


def width_of(template: str) -> int:
    """The least of ``WIDTHS`` that holds a template (the largest, for longer ones)."""
    n = len(words_of(template))
    return next((w for w in WIDTHS if n <= w), WIDTHS[-1])


def rivals(sets: dict[str, set[str]], threshold: float) -> dict[str, list[str]]:
    """For each template those others that have ``threshold`` of its words."""
    return {k: [j for j in sets if j != k and len(sets[j] & s) >= threshold * len(s) - 1e-9] for k, s in sets.items()}


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    The score is 1 for a document with a base phrase, else the largest containment of
    a template that reached the threshold, else 0."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    sets, widths = {k: set(words_of(t)) for k, t in templates.items()}, {k: width_of(t) for k, t in templates.items()}
    spark = docs.sparkSession
    read = docs.select("doc_id", text_or_empty().alias("text")).withColumn("spaced", spaced(F.col("text"))).drop("text")
    order = vocabulary_order(read, sorted(set().union(*sets.values())))
    rank = {w: i for i, w in enumerate(order)}
    need = {k: math.ceil(threshold * len(s) - 1e-9) for k, s in sets.items()}
    sorted_sets = {k: sorted(s, key=rank.__getitem__) for k, s in sets.items()}
    starts = {k: s[: len(s) - need[k] + 1] for k, s in sorted_sets.items()}

    words = F.split("spaced", " ")
    own = read.withColumn("own", F.array_intersect(F.lit(order), words))
    reached = [F.size(F.array_intersect(F.lit(s), F.col("own"))) >= need[k] for k, s in sorted_sets.items()]

    def blocks(every_word: Column, width: int) -> Column:
        """The windows of a width with enough words of its templates: those words, rarest first."""
        vocabulary = [w for w in order if any(w in sets[k] for k in sets if widths[k] == width)]
        least = min(need[k] for k in sets if widths[k] == width)
        cut = F.transform(
            F.sequence(F.lit(0), F.size(every_word) - 1, F.lit(width)),
            lambda i: F.struct(F.lit(width).alias("width"), i.alias("start"), F.array_intersect(F.lit(vocabulary), F.slice(every_word, i + 1, 2 * width)).alias("block")),
        )
        return F.filter(cut, lambda b: F.size(b["block"]) >= least)

    # a text is split once, not for each window
    every = F.transform(F.array(words), lambda ws: F.concat(*(blocks(ws, w) for w in sorted(set(widths.values())))))[0]
    kept = written(
        base_places(own, phrases)
        .withColumn("blocks", F.when(reduce(lambda a, b: a | b, reached), every))
        .withColumn("row", F.monotonically_increasing_id())
        .drop("own", "spaced"),
        "license-blocks",
    )
    template_starts = spark.createDataFrame(
        [(k, widths[k], len(s), need[k], s, w, i) for k, s in sorted_sets.items() for i, w in enumerate(starts[k])],
        "label string, width int, size int, need int, words array<string>, word string, at int",
    )
    found_blocks = kept.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    block_starts = found_blocks.select("row", "width", "start", "block", F.posexplode("block").alias("block_at", "word"))
    rest = F.least(F.size("block") - F.col("block_at"), F.col("size") - F.col("at"))
    prefix = F.col("block_at") <= F.size("block") - F.col("need")
    reaching = (
        block_starts.join(F.broadcast(template_starts), ["width", "word"])
        .filter(prefix & (rest >= F.col("need")))
        .withColumn("shared", F.size(F.array_intersect("block", "words")))
        .filter(F.col("shared") >= F.col("need"))
        .groupBy("row", "label", "size")
        .agg(F.max("shared").alias("shared"))
    )
    reached_by = F.struct((F.col("shared") / F.col("size")).alias("share"), "shared")
    found = reaching.groupBy("row").agg(F.collect_list(F.struct("label", reached_by.alias("reach"))).alias("all"))
    over = rivals(sets, threshold)
    rival = F.create_map(*(x for k in sets for x in (F.lit(k), F.array(*map(F.lit, over[k])) if over[k] else F.array().cast("array<string>"))))
    names = F.create_map(*(x for k in sets for x in (F.lit(k), F.lit(label_of(k)))))
    beaten = lambda x: F.exists("all", lambda y: F.array_contains(F.element_at(rival, x["label"]), y["label"]) & (y["reach"] > x["reach"]))
    found = found.select(
        "row", F.transform(F.filter("all", lambda x: ~beaten(x)), lambda x: F.element_at(names, x["label"])).alias("found"),
        F.array_max(F.transform("all", lambda x: x["reach"]["share"])).alias("containment"),
    )
    method = F.coalesce("found", F.array().cast("array<string>"))
    return kept.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base_found")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_found", method)), ",").alias("labels"),
        F.round(F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))), 6).alias("score"),
    )


def oracle(phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = 0.8) -> str:
    """The same in DuckDB SQL, comparing every window with every template of its width."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrase_rows = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in phrases.items())
    template_rows = ", ".join(
        f"('{k}', {quoted(sorted(set(words_of(t))))}, {math.ceil(threshold * len(set(words_of(t))) - 1e-9)}, {width_of(t)})" for k, t in templates.items()
    )
    pairs = [(k, j) for k, own in rivals({k: set(words_of(t)) for k, t in templates.items()}, threshold).items() for j in own]
    rival_rows = f"VALUES {', '.join(map(str, pairs))}" if pairs else "SELECT '', '' WHERE false"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, {word}) AS words
  FROM documents),
p(phrase, label) AS (VALUES {phrase_rows}),
t(label, words, need, width) AS (VALUES {template_rows}),
places AS (
  SELECT id, label, i - 1 AS place
  FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM d) JOIN p ON words[i] = phrase[1]
  WHERE words[i : i + len(phrase) - 1] = phrase),
base AS (
  SELECT id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY id),
block AS (
  SELECT id, width, i, list_distinct(words[i + 1 : i + 2 * width]) AS block
  FROM (SELECT id, words, width, unnest(range(0, len(words), width)) AS i FROM d CROSS JOIN (SELECT DISTINCT width FROM t))),
met AS (
  SELECT id, label, len(list_intersect(block, t.words)) / len(t.words) AS c, len(list_intersect(block, t.words)) AS s
  FROM block JOIN t ON block.width = t.width WHERE len(list_intersect(block, t.words)) >= need),
best AS (SELECT id, label, max(c) AS c, max(s) AS s FROM met GROUP BY 1, 2),
rival(label, other) AS ({rival_rows}),
named(label, name) AS (VALUES {", ".join(f"('{k}', '{label_of(k)}')" for k in templates)}),
own AS (
  SELECT id, list(DISTINCT name) AS labels, max(c) AS best FROM best AS x JOIN named USING (label)
  WHERE NOT EXISTS (SELECT 1 FROM best AS y JOIN rival ON other = y.label WHERE rival.label = x.label AND y.id = x.id AND (y.c > x.c OR (y.c = x.c AND y.s > x.s)))
  GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
       round(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END, 6)::DOUBLE AS score
FROM d LEFT JOIN base USING (id) LEFT JOIN own USING (id)
"""
