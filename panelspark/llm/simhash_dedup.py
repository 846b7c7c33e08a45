"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits: a bit is set where over half of the text's shingle hashes
(XXH64, seed 42) have it. Two link if at most ``distance`` bits differ.

The bits are dealt into parts, strongly correlated bits into the same one. If the
parts' thresholds add up to distance - parts + 1, any two linked fingerprints differ
in some part by no more than its threshold. Dynamic programming picks the thresholds
(-1: the part is not used) with the fewest expected candidates, which come from the
parts' exact numbers of equal keys over all distinct fingerprints and the odds of
differing bits. Fingerprints probe the keys within a part's threshold and candidates
are verified.

Equal fingerprints are one node, so copies cost nothing. Keys that more than
``bucket`` distinct fingerprints share are not paired: their members go, exactly, to
the balls of distance / 2 bits around them instead, since two fingerprints are linked
just if their balls meet; no ball holds many fingerprints.

A null or blank text has fingerprint zero, linked like any other. Repeated rows are
rows of one component. Null ids count as larger than any other (a component of these
alone has a null id). An empty table gives an empty result. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from panelspark.llm.common import first_rows, row_hashes, written
from panelspark.llm.components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, block: int = 1 << 16) -> int:
    """The text's fingerprint as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    set_bits = np.zeros(BITS, dtype=np.int64)
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, len(starts), block):
        hashes = np.array([hash_of(joined[s:e], 42) for s, e in zip(starts[at : at + block], ends[at : at + block], strict=True)], dtype=">u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts)).view(">i8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """Fingerprints of a column of texts, in Arrow batches."""

    @F.pandas_udf(T.LongType())
    def of_batch(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of_batch(text)


def bit_correlations(distinct: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each bit's share of ones and the bits' absolute correlations, over all rows.

    Tasks send sums of products of bits: 64 x 64 numbers each, merged by Spark."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fingerprint"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total.ravel().astype(np.int64)})

    n = distinct.count()
    sums = np.zeros((BITS, BITS))
    for r in distinct.select("fingerprint").mapInPandas(products, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        sums[r["i"], r["j"]] = r["n"]
    ones = np.diag(sums) / max(n, 1)
    spread = np.sqrt(ones * (1 - ones))
    with np.errstate(divide="ignore", invalid="ignore"):
        correlation = np.abs((sums / max(n, 1) - np.outer(ones, ones)) / np.outer(spread, spread))
    return ones, np.nan_to_num(correlation)


def correlated_parts(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into parts of about equal size: each part starts with the most
    correlated pair left and takes the bit most correlated with it, again and again."""
    bits = len(correlation)
    left, out = set(range(bits)), []
    for k in range(parts):
        size = bits * (k + 1) // parts - bits * k // parts
        pairs = [(correlation[i, j], -i, -j) for i, j in combinations(sorted(left), 2)]
        mine = [-x for x in max(pairs)[1:]] if size > 1 and pairs else [min(left)]
        left -= set(mine)
        while len(mine) < size:
            nearest = max(left, key=lambda b: (correlation[b, mine].sum(), -b))
            mine.append(nearest)
            left.remove(nearest)
        out.append(sorted(mine))
    return out


def key_of(fingerprints: Column, bits: list[int]) -> Column:
    """The bits of a part, packed together."""
    key = F.lit(0).cast("long")
    for at, bit in enumerate(bits):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fingerprints, bit).bitwiseAND(F.lit(1)), at))
    return key


def expected_candidates(ones: np.ndarray, bits: list[int], equal: float, most: int) -> list[float]:
    """Expected pairs of keys within 0, 1 .. ``most`` differing bits, from the pairs of equal keys."""
    differ = 2 * ones[bits] * (1 - ones[bits])
    odds = differ / np.maximum(1 - differ, 1e-9)
    by_bits = np.zeros(most + 1)
    by_bits[0] = 1.0
    for o in odds:
        by_bits[1:] = by_bits[1:] + o * by_bits[:-1]
    return list(equal * np.cumsum(by_bits))


def best_thresholds(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds (-1 or more) that add up to ``total`` at the least cost; costs[part][threshold]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for threshold in range(-1, len(part)):
                option = (cost + (part[threshold] if threshold >= 0 else 0.0), [*chosen, threshold])
                if spent + threshold not in following or option < following[spent + threshold]:
                    following[spent + threshold] = option
        best = following
    return best[total][1]


def flips(bits: int, most: int) -> list[int]:
    """Masks of at most ``most`` of the lowest ``bits`` bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(distinct: DataFrame, distance: int = 2, parts: int = 3, bucket: int = 24) -> DataFrame:
    """a and b: pairs of different fingerprints whose links connect all that is linked.

    ``distinct`` has each fingerprint once. Pairs within shared keys are complete up to
    ``bucket`` members; beyond, members are linked to the smallest fingerprint of each
    ball that they lie in. ``distance`` must be even."""
    if distance % 2:
        raise ValueError("distance must be even")
    ones, correlation = bit_correlations(distinct)
    dealt = correlated_parts(correlation, parts)
    keyed = distinct.select(
        "fingerprint",
        F.explode(F.array(*(F.struct(F.lit(i).alias("part"), key_of(F.col("fingerprint"), b).alias("key")) for i, b in enumerate(dealt)))).alias("at"),
    ).select("fingerprint", "at.part", "at.key")
    sizes = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("held"))
    equal = {r["part"]: float(r["pairs"]) for r in sizes.groupBy("part").agg(F.sum(F.col("held") * F.col("held")).alias("pairs")).collect()}
    costs = [expected_candidates(ones, b, equal.get(i, 0.0), distance) for i, b in enumerate(dealt)]
    thresholds = best_thresholds(costs, distance - parts + 1)
    used = [i for i, t in enumerate(thresholds) if t >= 0]
    members = keyed.filter(F.col("part").isin(used)).join(sizes, ["part", "key"])
    masks = F.lit(None)
    for i in used:
        masks = F.when(F.col("part") == i, F.lit(flips(len(dealt[i]), thresholds[i]))).otherwise(masks)
    if any(thresholds[i] for i in used):
        probes = keyed.filter(F.col("part").isin(used)).select(
            F.col("fingerprint").alias("other"), "part", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("key")))).alias("key")
        )
        crowded_probes = probes.join(sizes.filter(F.col("held") > bucket), ["part", "key"]).select(F.col("other").alias("fingerprint"))
    else:
        probes = keyed.filter(F.col("part").isin(used)).select(F.col("fingerprint").alias("other"), "part", "key")
        crowded_probes = None
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= distance
    pairs = (
        members.filter(F.col("held") <= bucket)
        .join(probes, ["part", "key"])
        .filter((F.col("fingerprint") < F.col("other")) & near)
        .select(F.col("other").alias("a"), F.col("fingerprint").alias("b"))
    )
    crowded = members.filter(F.col("held") > bucket).select("fingerprint")
    if crowded_probes is not None:
        crowded = crowded.unionByName(crowded_probes)
    ball = F.explode(F.transform(F.lit(flips(BITS, distance // 2)), lambda m: m.bitwiseXOR(F.col("fingerprint"))))
    in_balls = crowded.distinct().select("fingerprint", ball.alias("centre"))
    starred = (
        in_balls.withColumn("lowest", F.min("fingerprint").over(Window.partitionBy("centre")))
        .filter("lowest <> fingerprint")
        .select(F.col("fingerprint").alias("a"), F.col("lowest").alias("b"))
    )
    return pairs.unionByName(starred).distinct()


def grouped_rows(docs: DataFrame, shingle: int, distance: int, parts: int = 3, bucket: int = 24) -> DataFrame:
    """doc_id, id_hash, text_hash, fingerprint, and first (no_id, doc_id, id_hash, text_hash) of the
    row with the smallest doc_id of its group, of every row of ``docs``."""
    marked = written(docs.select("doc_id", *row_hashes(), fingerprint_column(F.col("text"), shingle).alias("fingerprint")), "fingerprints")
    own_row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "id_hash", "text_hash")
    distinct = written(marked.groupBy("fingerprint").agg(F.min(own_row).alias("own_first")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fingerprint"), distance, parts, bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = rooted.groupBy("root").agg(F.min("own_first").alias("first"))
    return marked.join(rooted.join(smallest, "root").select("fingerprint", "first"), "fingerprint")


def group_documents(docs: DataFrame, shingle: int = 3, distance: int = 2, parts: int = 3, bucket: int = 24) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``."""
    return grouped_rows(docs, shingle, distance, parts, bucket).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of ``docs`` of each group, one with its smallest doc_id."""
    return first_rows(docs, grouped_rows(docs, shingle, distance))
