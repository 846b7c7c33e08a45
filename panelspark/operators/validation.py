"""Checks of result tables: each returns the rows that break a rule (table, rule, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scale below which results are not final: bootstrap draws, permutations, simulations.
FULL_DRAWS, FULL_PERMS, FULL_SIMS = 5000, 10000, 1000


def violations(frame: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each row of ``frame`` and rule (a column that is true for what breaks it)."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))
    detail = F.to_json(F.struct(*(F.col(f"`{c}`") for c in frame.columns)))
    return frame.select(F.lit(table).alias("table"), F.explode(broken).alias("rule"), detail.alias("detail"))


def not_finite(frame: DataFrame, table: str, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Infinite numbers anywhere, and missing ones outside ``nullable``; an empty table breaks a rule itself."""
    numbers = [c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint")]
    doubles = [c for c, t in frame.dtypes if t in ("double", "float")]
    rules = {f"infinite {c}": F.abs(F.col(c)) == float("inf") for c in doubles}
    rules |= {f"missing {c}": F.col(c).isNull() | (F.isnan(c) if c in doubles else F.lit(False)) for c in numbers if c not in nullable}
    empty = frame.agg(F.count(F.lit(1)).alias("rows")).filter("rows = 0").select(F.lit(table).alias("table"), F.lit("empty").alias("rule"), F.lit("{}").alias("detail"))
    return violations(frame, table, rules).unionByName(empty) if rules else empty


def adjusted_below_raw(menu: DataFrame, table: str = "romano_wolf") -> DataFrame:
    """Adjusted p-values below the raw ones."""
    return violations(menu, table, {"adjusted below raw": F.col("p_adjusted") + 1e-12 < F.col("p_raw")})


def below_scale(frame: DataFrame, table: str, column: str, least: int, where: Column | None = None) -> DataFrame:
    """Rows (of ``where``) that rest on fewer draws than ``least``."""
    return violations(frame if where is None else frame.filter(where), table, {f"{column} below {least}": F.col(column) < least})


def benchmark_rules(scale: float = 0.5, tolerance: float = 1e-10) -> dict[str, Column]:
    """Rules against a panel that isn't its direct portfolio but for a scale."""
    return {"sharpe differs": F.col("sharpe_abs_diff") > tolerance, "scale differs": F.abs(F.col("median_scale") - scale) > tolerance}


def benchmark_off(benchmark: DataFrame, table: str = "momentum_benchmark", scale: float = 0.5, tolerance: float = 1e-10) -> DataFrame:
    """A panel that isn't its direct portfolio but for a scale."""
    return violations(benchmark, table, benchmark_rules(scale, tolerance))


def provenance_rules() -> dict[str, Column]:
    """Rules against empty files and what is no sha256."""
    return {"empty file": F.col("bytes") <= 0, "no sha256": F.length("sha256") != 64}


def bad_provenance(files: DataFrame, table: str = "provenance") -> DataFrame:
    """Empty files and what is no sha256."""
    return violations(files, table, provenance_rules())


def missing_keys(wanted: DataFrame, found: DataFrame, table: str) -> DataFrame:
    """Rows of ``wanted`` keys that ``found`` doesn't have, each once."""
    gone = wanted.distinct().exceptAll(found.select(*wanted.columns).distinct())
    return gone.select(F.lit(table).alias("table"), F.lit("missing").alias("rule"), F.to_json(F.struct(*wanted.columns)).alias("detail"))


def shared_keys(one: DataFrame, two: DataFrame) -> DataFrame:
    """Keys that both tables have."""
    return one.intersect(two.select(*one.columns))


def all_violations(*checks: DataFrame) -> DataFrame:
    """What all checks found."""
    return reduce(DataFrame.unionByName, checks)
