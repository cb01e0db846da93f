"""Connected components of an undirected graph, without ever holding a component in one place.

Alternating large-star and small-star steps: every round joins neighbours to the least node around them, and the graph
becomes a forest of stars after about log(n) rounds. Each round is written to the shared folder, which cuts the
lineage. A round only groups by node with a minimum (partially aggregated before the shuffle), so hot nodes cost one
aggregated row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (v, u): u's neighbours are re-linked to the least of u and its neighbours."""
    if large:
        near = edges.select(F.col("v").alias("node"), F.col("u").alias("other")).unionByName(edges.select(F.col("u").alias("node"), F.col("v").alias("other")))
    else:
        near = edges.select(F.greatest("v", "u").alias("node"), F.least("v", "u").alias("other"))
    least = near.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("m", "node"))
    linked = near.join(least, "node")
    if large:
        out = linked.where(F.col("other") > F.col("node")).select(F.col("other").alias("v"), F.col("m").alias("u"))
    else:
        out = linked.select(F.col("other").alias("v"), F.col("m").alias("u")).unionByName(least.select(F.col("node").alias("v"), F.col("m").alias("u")))
    return out.where("v != u").distinct()


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst) -> (node, component): the component is the least node in it. Loops and repeats do no harm."""
    edges = materialise(links.where("src is not null and dst is not null and src != dst").select(F.col("src").alias("v"), F.col("dst").alias("u")).distinct(), "edges")
    checksum = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    last = None
    for _ in range(max_rounds):
        edges = materialise(_star(_star(edges, True), False), "edges")
        now = tuple(edges.agg(F.count("*"), checksum).first())
        if now == last:
            break
        last = now
    else:
        raise ValueError(f"components have not settled after {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
