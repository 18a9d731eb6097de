"""Connected components of an edge table, by alternating large and small stars.

Every step links nodes to the smallest neighbour, so the number of rounds grows with the logarithm of a component's
size; hubs are aggregated before they are joined, and nothing is collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.staging import release, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of every node's neighbours (the larger ones, or the smaller ones with the node itself) to its smallest."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
    joined = both.join(low, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))) \
        .where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b long): the smallest node reachable. Nulls and loops are left
    out. Runs its rounds when called."""
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = None
    while True:
        new = staged(_star(_star(edges, True), False).distinct(), "edges")
        after = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")).first()
        release(edges)
        edges = new
        if after == state:
            break
        state = after
    top = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        top.select("node", F.col("node").alias("component")))
