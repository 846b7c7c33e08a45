"""A quality classifier over document statistics.

Statistics of the whole text are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Ridge regression on the labels is
solved from the normal equations: tasks sum them over their rows, Spark sums the
tasks' sums, and the driver solves a system of the size of the feature map. Scores are
calibrated by isotonic regression on counts of labels in ``BINS`` bins of the ridge
score, so what the driver sees never grows with the documents.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. Language,
source, doc_id and labels are no inputs of a score. A null text counts as empty and is
scored; a row with a null doc_id is scored and not held out; repeated rows are scored
each, and repeated labels count each; without any label to learn from every score is
0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written

FEATURES = 256
#: Labelled rows that the filter of a corpus is fitted on, at most.
SAMPLE = 200_000
BINS = 1000
#: Share of the final score that keeps the ridge score's order within flat steps.
SLOPE = 1e-3
_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "shout", "symbol", "high", "other")
_CLASS_OF = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
for _name, _bytes in {
    "lower": range(ord("a"), ord("z") + 1), "upper": range(ord("A"), ord("Z") + 1), "digit": range(ord("0"), ord("9") + 1),
    "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".,;:?'\"()-", "shout": b"!", "symbol": b"#*$%&|<>@^~_=+{}[]\\/", "high": range(128, 256),
}.items():
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)
STATISTICS = (*_CLASSES, "words", "word_length", "distinct", "top", "distinct_pairs", "lines", "repeated_lines", "entropy")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, all of them near 0 to 1 or logarithms."""
    data = (text or "").encode()
    counts = np.zeros(len(_CLASSES))
    bytes_held = np.zeros(256)
    for at in range(0, len(data), 1 << 20):
        bytes_held += np.bincount(np.frombuffer(data, dtype=np.uint8, offset=at, count=min(1 << 20, len(data) - at)), minlength=256)
    np.add.at(counts, _CLASS_OF, bytes_held)
    size = max(1, len(data))
    shares = bytes_held[bytes_held > 0] / size
    words = data.split()
    n = max(1, len(words))
    held = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        *(counts / size),
        math.log1p(len(words)),
        math.log1p(sum(map(len, words)) / n),
        len(held) / n,
        max(held.values(), default=0) / n,
        pairs / max(1, len(words) - 1),
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        float(-(shares * np.log2(shares)).sum()) / 8,
    ]


def statistics_column(text: Column) -> Column:
    """The statistics of a column of texts."""

    @F.pandas_udf("array<double>")
    def of_batch(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return of_batch(text)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


@dataclass
class Model:
    """A fitted classifier; ``apply`` scores rows of statistics."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """The random Fourier features, and a constant."""
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        """The scores before calibration, 0 to 1 or nearly."""
        return self.features(x) @ self.weights

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1."""
        raw = self.ridge(x)
        flat = np.interp(raw, self.knots, self.values)
        return (1 - SLOPE) * flat + SLOPE * np.clip((raw + 1) / 3, 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def _bin_sums(rows: DataFrame, model: Model) -> list:
    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = model.ridge(np.array(batch["x"].tolist()).reshape(-1, len(STATISTICS)))
            at = np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(int)
            yield pd.DataFrame({"bin": at, "n": 1, "ones": batch["y"].astype(int)}).groupby("bin", as_index=False).sum()

    found = rows.mapInPandas(binned, "bin int, n long, ones long")
    return found.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("bin").collect()


def fit(rows: DataFrame, features: int = FEATURES, width: float = 3.0, ridge: float = 1e-3, seed: int = 11) -> Model | None:
    """Fit on ``rows`` (x: statistics, y: 0 or 1); None without rows. ``width`` is the kernel's."""
    d = len(STATISTICS)
    moments = rows.select(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)),
        *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)),
    ).first()
    if not moments["n"]:
        return None
    rng = np.random.default_rng(seed)
    spread = np.array([moments[f"s{i}"] for i in range(d)])
    model = Model(
        np.array([moments[f"m{i}"] for i in range(d)]), np.where(spread > 1e-9, spread, 1.0),
        rng.normal(0, 1 / width, (d, features)), rng.uniform(0, 2 * math.pi, features), np.zeros(features + 1), np.zeros(0), np.zeros(0),
    )

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            z = model.features(np.array(batch["x"].tolist()).reshape(-1, d))
            total += z.T @ np.hstack([z, batch["y"].to_numpy(dtype=float)[:, None]])
        yield pd.DataFrame({"row": range(features + 1), "terms": list(total)})

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": group["row"][:1], "terms": [np.sum(group["terms"].tolist(), axis=0)]})

    parts = rows.mapInPandas(equations, "row int, terms array<double>")
    system = np.array([r["terms"] for r in parts.groupBy("row").applyInPandas(summed, "row int, terms array<double>").orderBy("row").collect()])
    n = moments["n"]
    model.weights = np.linalg.solve(system[:, :-1] + ridge * n * np.diag([*np.full(features, 1.0 / features), 1e-9]), system[:, -1])
    bins = _bin_sums(rows, model)
    model.knots = np.array([(r["bin"] + 0.5) / BINS * 3 - 1 for r in bins])
    model.values = isotonic(np.array([r["ones"] / r["n"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    return model


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics, of every row, written once to be learnt from and scored."""
    return written(docs.select("doc_id", statistics_column(F.col("text")).alias("x")), "statistics")


def usable(labels: DataFrame) -> DataFrame:
    """doc_id and y of the labels that may be learnt from."""
    return labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 1)).select("doc_id", F.col("quality").alias("y"))


def fit_on_labels(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled rows of ``stats`` that aren't held out."""
    return fit(written(stats.join(usable(labels), "doc_id").select("x", "y"), "labelled-statistics"))


def score(x: Column, model: Model | None) -> Column:
    """The calibrated score of a column of statistics."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def of_batch(rows: pd.Series) -> pd.Series:
        return pd.Series(model.apply(np.array(rows.tolist()).reshape(-1, len(STATISTICS))), dtype="float64")

    return of_batch(x)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    stats = with_statistics(docs)
    model = fit_on_labels(stats, labels)
    return stats.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), score(F.col("x"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more.

    Fitted on the labels with the ``sample`` smallest hashes of doc_id: so many are broadcast beside the texts, of which
    only theirs are worked on before all are scored, once."""
    some = usable(labels).orderBy(F.xxhash64("doc_id", "y"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    model = fit(written(rows.select(statistics_column(F.col("text")).alias("x"), "y"), "labelled-statistics"))
    return docs.filter(score(statistics_column(F.col("text")), model) >= least)
