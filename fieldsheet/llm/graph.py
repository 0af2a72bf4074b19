"""Connected components of large graphs by alternating star operations."""

from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import materialize
from .common import join_unique


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected ``edges`` (a, b); a component is named by its least node.

    In every round all larger neighbours of a node are tied to its least neighbour, then all smaller
    ones (Kiveris et al., "Connected components in MapReduce and beyond", 2014), until nothing
    changes. Nodes with very many neighbours are joined apart from the others. Rounds grow with the logarithm of the size; each is written to the shared folder. Edges
    with equal ends or nulls are ignored.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b")
                        .distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = join_unique(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_unique(large, least, "u", "n").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # every edge now leads from a node to the least of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
