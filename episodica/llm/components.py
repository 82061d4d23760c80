"""Connected components of an edge table, by DataFrame operations alone.

Edges are (a, b) pairs of longs, links between nodes. Both methods return (id, component) for every node that has an
edge, the component being its smallest id. Each round is written to the shared folder; nothing but counts of changed rows
reaches the driver. A node with many edges is pre-aggregated before it is shuffled, and its side of a join is one
that Spark's adaptive skew handling can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def star_components(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star until the edges stand still."""
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node's edges to smaller nodes: the smallest of them takes over the others and the node.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = _mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def union_find(edges: DataFrame) -> DataFrame:
    """Union-find over tables: roots hook onto their smallest neighbour, paths are halved until flat, edges contract."""
    edges = stage(edges.where("a != b").select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    parent = stage(nodes.withColumn("component", F.col("id")))
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).where("p < id")
        flat = stage(hooks)
        while True:
            up = flat.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            halved = stage(flat.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            flat = halved.drop("moved")
            if not halved.where("moved").take(1):
                break
        roots = flat.select(F.col("id").alias("component"), "p")
        parent = stage(parent.join(roots, "component", "left").select("id", F.coalesce("p", "component").alias("component")))
        root_a, root_b = flat.select(F.col("id").alias("a"), F.col("p").alias("ra")), flat.select(F.col("id").alias("b"), F.col("p").alias("rb"))
        moved = edges.join(root_a, "a", "left").join(root_b, "b", "left")
        moved = moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = stage(moved.where("a != b").distinct())
    return parent
