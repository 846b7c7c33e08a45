"""Sharding by a Hilbert curve over metadata.

Three metadata dimensions (size, source, language) are each quantised into
``2 ** bits`` cells of about equal depth, a row's cell numbers give its index on the
Hilbert curve through the grid, and the rows in curve order are cut into runs of
counts at most one apart (law ``rows``). Neighbours on the curve are near in every
dimension, so each run covers a small box and min/max statistics of its files prune
on any of the three.

The order is (curve index, slice, doc_id, text_crc32), where the slice is a hash of
the row: a cell has as many slices as keep each near ``slice_rows`` rows, so however many
rows one curve cell holds, no task sorts more than a slice of them. Strings are
quantised whole, by their place among all rows. Ranks come from counts of (cell, slice), never from one global sort.

Nulls in a dimension count as an empty string, a null text has no bytes, repeated
rows get a place each, an empty table gives an empty result, and columns other than
doc_id, text, source and lang are not read.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import written

DIMENSIONS = ("size", "source_key", "lang_key")


def hilbert_index(cell: tuple[int, ...], bits: int) -> int:
    """Index of a grid cell on the Hilbert curve of order ``bits``, from the curve's
    recursive rule on transposed axes (exchange or invert the lower bits of each axis,
    then Gray-decode)."""
    x, n = list(cell), len(cell)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    x = [v ^ flip for v in x]
    index = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> bit & 1)
    return index


#: Distinct strings of one range, about.
RANGE_VALUES = 1 << 20


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and what the curve's dimensions quantise."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.coalesce("lang", F.lit("")).alias("lang_key"),
    )


def string_cuts(rows: DataFrame, name: str, cells: int, range_values: int = RANGE_VALUES) -> list[str]:
    """Up to ``cells`` - 1 strings that cut the rows, in the order of the whole string, into levels of
    about equal depth: the last string of each level but the highest.

    Distinct strings are counted, dealt to ranges of their order, of about ``range_values`` each, and numbered there; sums of
    the ranges, as many rows, give each its place among all rows."""
    values = written(rows.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("held")), f"{name}-values")
    ranges = values.count() // range_values + 1
    ranged = written(values.repartitionByRange(ranges, "value").withColumn("range", F.spark_partition_id()), f"{name}-ranges")
    sums = ranged.groupBy("range").agg(F.sum("held").alias("held"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum("held").over(inside), F.lit(0))).join(F.broadcast(sums), "range")
    level = F.floor((F.col("start") + F.col("inner")) * cells / F.col("total"))
    return sorted(r["last"] for r in placed.groupBy(level.alias("level")).agg(F.max("value").alias("last")).collect())[:-1]


def on_curve(rows: DataFrame, bits: int) -> DataFrame:
    """Add ``curve``, the Hilbert index of the row's cell.

    The cuts are approximate quantiles of the size and cuts of the strings over all rows: at most
    3 x (2 ** bits - 1) values that pass the driver. The table of the curve has 8 ** bits rows and is broadcast.
    """
    cells = 1 << bits
    shares = [i / cells for i in range(1, cells)]
    sizes = rows.select(F.percentile_approx("size", shares).alias("cuts")).first()["cuts"] or []
    cuts = {"size": sizes, **{d: string_cuts(rows, d, cells) for d in DIMENSIONS[1:]}}
    grid = F.lit(0)
    for d in DIMENSIONS:
        level = F.lit(0)
        for cut in cuts[d]:
            level = level + (F.col(d) > F.lit(cut)).cast("int")
        grid = grid * cells + level
    cell_order = rows.sparkSession.createDataFrame(
        [(i, hilbert_index(c, bits)) for i, c in enumerate(product(range(cells), repeat=len(DIMENSIONS)))],
        "grid int, curve int",
    )
    return rows.withColumn("grid", grid).join(F.broadcast(cell_order), "grid")


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 4, slice_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    rows = on_curve(written(metadata(docs), "shard-metadata"), bits)
    # 8 ** bits rows at most: one task may order them, and they may be broadcast
    by_cell = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("cell_held"))
    so_far = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = by_cell.select(
        "curve",
        F.ceil(F.col("cell_held") / slice_rows).cast("int").alias("slices"),
        F.coalesce(F.sum("cell_held").over(so_far), F.lit(0)).alias("cell_start"),
        F.sum("cell_held").over(Window.partitionBy()).alias("total"),
    )
    by_cell = written(by_cell, "shard-cells")
    rows = rows.join(F.broadcast(by_cell), "curve").withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), "slices").cast("int"))
    counts = rows.groupBy("curve", "slice").agg(F.count(F.lit(1)).alias("held"))
    in_cell = Window.partitionBy("curve").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("curve", "slice", F.coalesce(F.sum("held").over(in_cell), F.lit(0)).alias("slice_start"))
    within = Window.partitionBy("curve", "slice").orderBy("doc_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("nth", F.row_number().over(within))
        .join(starts, ["curve", "slice"])
        .withColumn("rank", F.col("cell_start") + F.col("slice_start") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"rank * {shards}L div total"))
    )
    first = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write ``docs`` (doc_id unique) as Parquet, a folder for each shard, rows in slot order."""
    places = placed.select(F.col("doc_id").alias("_placed"), F.col("shard"), F.col("slot"))
    (
        docs.drop("shard", "slot")
        .join(places, F.col("doc_id").eqNullSafe(F.col("_placed")))
        .drop("_placed")
        .repartition("shard", F.floor(F.col("slot") / 1_000_000))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
