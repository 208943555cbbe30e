"""Connected components of an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.session import forget, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a long, b long): root is the component's smallest node. A written table.

    Large-star and small-star steps by turns until no edge changes, which takes rounds in the logarithm of the largest component.
    The least neighbour of a node is found by a partial aggregate and joined back, so a node with very many edges is split as
    any skewed join is. Edges from a node to itself only name it; no edge gives no row.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == state or not mark[0]:
            break
        state = mark
        # every larger neighbour of a node gets an edge to the node's least neighbour
        wide = _both(now)
        least = wide.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = wide.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every smaller neighbour, and the node itself, gets an edge to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").union(low.select(F.col("a").alias("x"), "m"))
        last, now = now, written(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        forget(last)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    out = written(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    forget(now)
    return out
