"""URL filtering by host-suffix and path-prefix rules.

A URL is expanded into the expressions under which a rule may stand: each suffix of
its host at a label boundary, followed by each prefix of its path of a length that
rules have. Expressions meet rules in an equi-join on the first 32 bits of their
SHA-256, the full digests are then compared, and the longest rule wins (of equal
ones, ``block``). Distinct (host, start of path) pairs are expanded, not pages, so a
host with a third of all pages costs no more than any other. The pairs that a rule fits are counted: up to
``BROADCAST_ROWS`` of them are broadcast, so that pages stay where they are; more are joined by their values.

A null URL, or one without ``://``, has an empty host and path. Pages that no rule
fits get the default verdict and a null rule. Repeated pages are judged each; empty
tables of pages or rules are allowed; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import ascii_lower, written

#: Matched (host, start of path) pairs, of some hundred bytes each, that go to all tasks beside the pages.
BROADCAST_ROWS = 200_000
#: host, path, verdict
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """The rules as a DataFrame of host, path and verdict."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every page."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return pages.select("page_id", rest.alias("rest")).select(
        "page_id",
        ascii_lower(F.regexp_extract("rest", r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    # the rules' path lengths: as many as the longest rule path has characters at most
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    reach = max(lengths, default=0)
    expressions = (
        rules.withColumn("rule", F.concat("host", "path"))
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    judged = parsed(pages).withColumn("path_start", F.substring("path", 1, reach))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(F.split("host", r"\."))),
        lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.size(F.split("host", r"\."))), "."),
    )
    prefixes = F.filter(
        F.array(*(F.when(F.length("path_start") >= n, F.substring("path_start", 1, n)) for n in lengths)),
        lambda p: p.isNotNull(),
    )
    matched = (
        judged.filter(F.col("host") != "")
        .select("host", "path_start")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("expression", F.explode(F.transform(prefixes, lambda p: F.concat(F.col("suffix"), p))))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("short", F.substring("full", 1, 8))
        .join(expressions, "short")
        .filter(F.col("full") == F.col("digest"))
        .groupBy("host", "path_start")
        .agg(F.max(F.struct(F.length("rule").alias("length"), "rule", "verdict")).alias("best"))
        .select("host", "path_start", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    ) if lengths else None
    if matched is None:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    matched = written(matched, "matched-starts")
    if matched.count() <= BROADCAST_ROWS:
        matched = F.broadcast(matched)
    return judged.join(matched, ["host", "path_start"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def oracle(rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> str:
    """The same in DuckDB SQL, comparing every page with every rule."""
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {rows}),
u AS (
  SELECT row_number() OVER () AS id, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT id, page_id, regexp_extract(rest, '^[^/?#]*[^?#]*') AS kept,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY id ORDER BY length(rule_host || rule_path) DESC, verdict DESC) AS nth
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE nth = 1) USING (id)
"""
