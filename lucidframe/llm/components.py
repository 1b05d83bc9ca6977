"""Connected components of an edge table, without a driver-side or per-task copy of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lucidframe.session import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has longs a and b; gives v and comp, one and the same vertex of v's component, for every vertex of an edge.

    Each round every vertex points to that of its neighbours and itself with the smallest hash (a pre-aggregated
    minimum, so a hub is no hot task), both ends of all edges are renamed by it and loops and repeats go.  A star goes in
    two rounds; whatever the numbers of the vertices are, a fixed share of a chain is expected to go each round, so rounds
    grow with the logarithm of the largest component.  What a round leaves is written to the shared folder, and what it
    has read is removed.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, number = None, 0
    while not edges.isEmpty():
        order = lambda c, n=number // 8: F.xxhash64(F.col(c), F.lit(n))  # noqa: E731, another hash now and then, should two agree
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        low = materialize(both.groupBy("v").agg(F.min_by("w", order("w")).alias("w")).select("v", F.when(order("w") < order("v"), F.col("w")).otherwise(F.col("v")).alias("to")), "low")
        if labels is None:
            labels = materialize(low.withColumnRenamed("to", "comp"), "labels")
        else:
            before, labels = labels, materialize(labels.join(low.withColumnRenamed("v", "comp"), "comp", "left").select("v", F.coalesce("to", "comp").alias("comp")), "labels")
            release(before)
        renamed = edges.join(low.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(low.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        before, edges = edges, materialize(renamed.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        release(before, low)
        number += 1
    if labels is None:
        return materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("comp")), "labels")
    release(edges)
    return labels
