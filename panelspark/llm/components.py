"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written

#: Edges of one task: a round's tables are cut by what they hold.
TASK_EDGES = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) of every node of ``edges`` (a, b).

    Each round hangs every node's larger neighbours on its smallest one, then its
    smaller neighbours; a component becomes a star in a logarithmic number of rounds,
    whatever its diameter. Neighbourhoods are never gathered: a round is two joins
    with pre-aggregated minima. Each round's edges are written to the shared folder, by as many
    tasks as their number asks for.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    edges_now = now.count()
    state, tasks = None, edges_now // TASK_EDGES + 1
    while edges_now:
        both = now.coalesce(tasks)
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).coalesce(tasks).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = written(small.unionByName(lowest.select("u", F.col("low").alias("v"))).coalesce(tasks).distinct().coalesce(tasks), "edges")
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        tasks = state[0] // TASK_EDGES + 1
    # without edges there are no nodes
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
