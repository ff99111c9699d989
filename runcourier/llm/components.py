"""Connected components of links, by alternating stars.

Each round hangs the larger neighbours of a node, then the smaller ones, under the smallest. The
smallest neighbour is an aggregate, so a node with many links costs no task more than others; the
join that follows it can be split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import slim
from runcourier.session import cut


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """``edges``: (u, v) with u > v, each once."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).coalesce(parts)
    joined = both.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("_m", "u").alias("v")
        )
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(
            least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))
        )
    return moved.where("u > v").coalesce(parts).distinct().coalesce(parts)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for the nodes of the links; a component is its smallest node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    edges = slim(edges.distinct())
    parts = max(1, edges.rdd.getNumPartitions())
    state = None
    while True:
        edges = cut(_star(_star(edges, True, parts), False, parts))
        now = edges.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))
        ).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
