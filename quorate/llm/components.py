"""Connected components of an undirected graph given as edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node of its component.

    ``edges`` has two columns of one orderable type. Loops and repeated edges are allowed. Each round
    points the larger neighbours of a node at its smallest neighbour, then the node itself with its
    smaller neighbours; rounds end when the edges stop changing. Per node only a minimum is grouped
    (combined before the shuffle), so a node of very many edges is an ordinary join key that adaptive
    execution can split; no neighbour list is built. Each round's edges are written to the shared
    checkpoint folder, which cuts the lineage and survives lost executors.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialise(e)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(e: DataFrame) -> tuple[int, object]:
    hashed = F.xxhash64("u", "v")
    row = e.agg(F.count("*"), F.sum(hashed.cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return row[0], (row[1], row[2])
