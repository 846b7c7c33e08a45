"""The scan against a plain computation over every window and template."""

import math

from panelspark.llm import license_scan as ls

TEXTS = [
    None, "", "Under the MIT License under the mit license.", "x under the\nMIT license y", "CC BY-NC 4.0", "cc, by; nc cc by nc",
    "Apache License, Version 2.0 apache license version 2", "Released under the MIT License.\nfoo", "foo\nThis work is licensed under the GNU General Public License, version 3.",
    "work licensed under the GNU general public license", "ÀÉ under thé mit license", "This work is\nlicensed under the GNU", "word " * 5000 + "under the mit license",
]


def plain(text, threshold=0.8):
    words = ls.words_of(text or "")
    places = [(i, label) for p, label in ls.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    sets, reach = {k: set(ls.words_of(t)) for k, t in ls.TEMPLATES.items()}, {}
    for k, want in sets.items():
        width = ls.width_of(ls.TEMPLATES[k])
        most = max((len(want & set(words[i : i + 2 * width])) for i in range(0, len(words), width)), default=0)
        if most >= math.ceil(threshold * len(want) - 1e-9):
            reach[k] = (most / len(want), most)
    beaten = {k for k in reach for j in reach if j != k and len(sets[j] & sets[k]) >= threshold * len(sets[k]) and reach[j] > reach[k]}
    own, best = set(reach) - beaten, max((c for c, _ in reach.values()), default=0.0)
    own, base = {ls.label_of(k) for k in own}, {label for _, label in places}
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), round(1.0 if places else best, 6))


def test_scan_equals_plain(spark):
    docs = spark.createDataFrame([(i % 9, t, "e") for i, t in enumerate(TEXTS)], "doc_id long, text string, label string")
    got = sorted(map(str, (tuple(r) for r in ls.scan_licenses(docs).collect())))
    assert got == sorted(str((i % 9, *plain(t))) for i, t in enumerate(TEXTS))


def test_wrapped_notices_are_found(spark):
    """Notices broken over lines, with other words around them; the one of two alike that fits best wins."""
    wrap = lambda t, n: "\n * ".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    labels = ("mit-full", "bsd-full", "gpl-3-full", "agpl-3-full", "apache-2-full", "unlicense-full", "bsd-text", "isc-text", "mit-text", "unlicense-text", "zlib-text")
    docs = spark.createDataFrame([(i, "some words before " * 9 + wrap(ls.TEMPLATES[k], 7) + " and after" * 30) for i, k in enumerate(labels)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.scan_licenses(docs).collect()}
    assert got == {i: ls.label_of(k) for i, k in enumerate(labels)}


def test_labels_are_the_licenses():
    assert ls.label_of("mit-short-notice") == ls.label_of("mit-text") == "mit" and ls.label_of("gpl-3-full") == "gpl-3" and ls.label_of("other") == "other"
    assert set(ls.PHRASES.values()) <= {ls.label_of(k) for k in ls.TEMPLATES}


def test_empty_table(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
