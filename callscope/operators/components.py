"""Connected components of graphs of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.work import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (x, y): the smallest node that each node can reach, itself included.

    Each round ties every node's larger neighbours to its smallest one, then its smaller neighbours; rounds grow with the logarithm of the
    longest path, edges never in number. Rounds are written to the shared folder, so that a lost executor repeats one round at most.
    A node of very many edges is one key of joins that Spark may split, and of counts that are combined before the shuffle.
    """
    nodes = edges.select(F.col("x").alias("node")).union(edges.select("y")).where("node is not null").distinct()
    links = edges.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    links, before = materialize(links), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = links.union(links.select("v", "u"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = materialize(down.select("e.u", "e.v").where("u <> v").distinct())
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
