"""Verdicts against a plain reading of the rules."""

import re

from panelspark.llm import url_filter as uf

URLS = [
    None, "", "no scheme", "http://a.example.org/es/1", "http://EXAMPLE.org/en/12?x", "http://example.org", "http://example.org/", "https://x.com/fr/", "https://com/de/z#q",
    "http://notexample.org/es/", "ftp://a://b/c", "http://x.com?/fr/", "http://x.com#/fr/", "http://org./", "://org/", "http://" + "a." * 60 + "org/" + "p" * 3000, "http://ÉX.ORG/",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_verdicts_equal_plain(spark):
    pages = spark.createDataFrame([(i % 12, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = sorted(map(str, (tuple(r) for r in uf.filter_urls(pages, uf.rule_table(spark)).collect())))
    assert got == sorted(str((i % 12, *plain(u))) for i, u in enumerate(URLS * 2))


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in uf.filter_urls(pages, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert uf.filter_urls(pages.limit(0), uf.rule_table(spark)).collect() == []


def test_many_matches_are_joined(spark, monkeypatch):
    """The same verdicts, one host with most pages, whether or not the matches are broadcast."""
    urls = URLS + [f"http://hot.example.org/es/{i % 7}" for i in range(500)] + [f"http://h{i}.com/de/x" for i in range(50)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rows in (uf.BROADCAST_ROWS, 3):
        monkeypatch.setattr(uf, "BROADCAST_ROWS", rows)
        found = uf.filter_urls(pages, uf.rule_table(spark))
        assert {tuple(r) for r in found.collect()} == {(i, *plain(u)) for i, u in enumerate(urls)}
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) or rows == 3


def test_very_long_urls(spark):
    long = "http://" + "x." * 2000 + "org/en/" + "1" * 500_000
    pages = spark.createDataFrame([(1, long), (1, long)], "page_id long, url string")
    assert [tuple(r) for r in uf.filter_urls(pages, uf.rule_table(spark)).collect()] == [(1, *plain(long))] * 2
