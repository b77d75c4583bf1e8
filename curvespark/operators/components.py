"""Connected components by contraction of the edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespark.plans.lineage import discard, stored


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; component is the smallest node reachable.

    Each round points every label at its smallest neighbour, jumps those pointers twice, and contracts the
    edges: the edge list shrinks geometrically, so the rounds grow with the logarithm of a component's
    diameter. Aggregations combine map-side, so a node of very high degree stays cheap. Null ends and loops are ignored; an
    empty list gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    pairs = pairs.where("u is not null and v is not null and u <> v")
    pairs = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        parent = both.groupBy("u").agg(F.min("v").alias("p"))
        first = stored(parent.select(F.col("u").alias("label"), F.least("u", "p").alias("parent")), "parent")
        parent = first
        for _ in range(2):
            above = parent.select(F.col("label").alias("parent"), F.col("parent").alias("above"))
            parent = parent.join(above, "parent").select("label", F.col("above").alias("parent"))
        parent = stored(parent, "parent")
        if labels is None:
            moved_on = stored(parent.select(F.col("label").alias("node"), F.col("parent").alias("component")), "labels")
        else:
            moved = parent.select(F.col("label").alias("component"), "parent")
            moved_on = labels.join(moved, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
            moved_on = stored(moved_on, "labels")
        left = parent.select(F.col("label").alias("u"), F.col("parent").alias("pu"))
        right = parent.select(F.col("label").alias("v"), F.col("parent").alias("pv"))
        fewer = pairs.join(left, "u").join(right, "v").where("pu <> pv")
        fewer = stored(fewer.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        discard(first, parent, labels, pairs)
        pairs, labels = fewer, moved_on
        if pairs.isEmpty():
            return labels
