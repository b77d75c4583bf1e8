"""Longest paths in forests of any size, by joins that double the reach of pointers: rounds follow the logarithm of a tree's size or depth.

A tree is walked once around (each edge there and back); how far an arc is from the walk's end tells which of an edge's ends is the parent and which nodes
are above which. Distances from the root add up along the parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.components import connected_components
from curvespark.plans.lineage import discard, numbered, stored

#: Lengths are compared after rounding to so many decimals, so that the order of additions doesn't decide ties.
DECIMALS = 9


def _doubled(start: DataFrame, key: str, pointer: str, sums: tuple[str, ...]) -> DataFrame:
    """Follow pointers to their end (null), adding up ``sums`` on the way."""
    now = stored(start, "pointers")
    order = now.columns
    while not now.where(F.col(pointer).isNotNull()).isEmpty():
        after = now
        for _ in range(2):
            ahead = after.select(F.col(key).alias(pointer), F.col(pointer).alias("__next"), *(F.col(c).alias(f"__{c}") for c in sums))
            on = after.where(F.col(pointer).isNotNull()).join(ahead, pointer)
            summed = {c: F.col(c) + F.col(f"__{c}") for c in sums} | {pointer: F.col("__next")}
            # rows that have come to their end stay where they are: they have no place in a join
            after = on.select(*(summed.get(c, F.col(c)).alias(c) for c in order)).union(after.where(F.col(pointer).isNull()))
        after = stored(after, "pointers")
        discard(now)
        now = after
    return now


def rooted(tree: DataFrame, components: DataFrame) -> DataFrame:
    """``(component, id, parent, down, up, far, hops)`` of each node of a forest ``(u, v, w)`` that has an edge: its parent (null for the root, each component's smallest node), where the
    walk comes down to it and goes up from it for good (counted from the walk's end), and its distance from the root in length and edges."""
    named = numbered(tree.select("u", "v", "w").join(components.select(F.col("id").alias("u"), "component"), "u"), "edge", "arcs")
    # arc 2e goes from an edge's u to its v, arc 2e + 1 back: one number is carried around, not both ends
    there, back = (F.col("edge") * 2).alias("arc"), (F.col("edge") * 2 + 1).alias("arc")
    arcs = named.select("component", F.col("u").alias("a"), F.col("v").alias("b"), there).union(named.select("component", "v", "u", back))
    around = Window.partitionBy("a").orderBy("b")
    arcs = arcs.withColumn("after", F.lead("arc").over(around)).withColumn("first", F.first("arc").over(around))
    ends = F.col("after").isNull() & (F.col("a") == F.col("component"))  # the last return to the root ends the walk
    walk = arcs.select(F.col("arc").bitwiseXOR(F.lit(1)).alias("arc"), F.when(~ends, F.coalesce("after", "first")).alias("next"))
    ranked = _doubled(walk.withColumn("rank", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")), "arc", "next", ("rank",))
    way = lambda odd: F.max(F.when(F.col("arc").bitwiseAND(F.lit(1)) == odd, F.col("rank"))).alias("back" if odd else "there")
    both = ranked.groupBy(F.shiftright("arc", 1).alias("edge")).agg(way(0), way(1))
    down = F.col("there") > F.col("back")
    nodes = named.join(both, "edge").select("component", F.when(down, F.col("v")).otherwise(F.col("u")).alias("id"), F.when(down, F.col("u")).otherwise(F.col("v")).alias("parent"), F.greatest("there", "back").alias("down"), F.least("there", "back").alias("up"), "w")
    nodes = stored(nodes, "nodes")
    roots = nodes.groupBy("component").agg(F.max("down").alias("most")).select("component", F.col("component").alias("id"), F.lit(None).cast("long").alias("parent"), (F.col("most") + 1).alias("down"), F.lit(-1).cast("long").alias("up"), F.lit(0.0).alias("w"))
    every = nodes.union(roots)
    lengths = _doubled(every.select("id", F.col("parent").alias("above"), F.col("w").alias("far"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops")), "id", "above", ("far", "hops"))
    found = stored(every.drop("w").join(lengths.select("id", "far", "hops"), "id").select("component", "id", "parent", "down", "up", "far", "hops"), "rooted")
    discard(named, ranked, nodes, lengths)
    return found


def _above(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes on the way from each component's ``end`` to the root, both included."""
    bottom = ends.join(nodes.select(F.col("id").alias("end"), F.col("down").alias("e_down"), F.col("up").alias("e_up")), "end")
    return nodes.join(bottom, "component").where((F.col("down") >= F.col("e_down")) & (F.col("up") <= F.col("e_up"))).select(*nodes.columns)


def _farthest(nodes: DataFrame, far: Column) -> DataFrame:
    best = F.max(F.struct(F.round(far, DECIMALS).alias("far"), (-F.col("id")).alias("m"))).alias("b")
    return nodes.groupBy("component").agg(best).select("component", (-F.col("b.m")).alias("end"), F.col("b.far").alias("length"))


def longest_paths(tree: DataFrame, components: DataFrame) -> DataFrame:
    """``(component, length, k, id)``: the nodes of each tree's longest path in order.

    It leads from the node farthest from the smallest one to the node farthest from that; of several equally far, the smallest.
    """
    nodes = rooted(tree, components)
    one = stored(_farthest(nodes, F.col("far")).select("component", "end"), "ends")
    trunk = stored(_above(nodes, one), "trunk")
    # the trunk's node nearest to each node, below which it hangs
    on = trunk.select("id", F.lit(True).alias("on"))
    hang = nodes.select("id", "parent").join(on, "id", "left").select("id", F.when(F.col("on"), None).otherwise(F.col("parent")).alias("above"))
    top = _tops(hang)
    start = trunk.join(one, (trunk["component"] == one["component"]) & (trunk["id"] == one["end"])).select(trunk["component"], trunk["far"].alias("a_far"), trunk["hops"].alias("a_hops"))
    tops = nodes.join(top, "id").join(trunk.select(F.col("id").alias("top"), F.col("far").alias("t_far"), F.col("hops").alias("t_hops")), "top").join(start, "component")
    tops = stored(tops, "tops")
    two = _farthest(tops, F.col("a_far") + F.col("far") - 2 * F.col("t_far"))
    meet = stored(two.join(tops.select("id", "t_hops", "a_hops"), F.col("end") == F.col("id")).select("component", "end", "length", "t_hops", "a_hops"), "meet")
    up = trunk.join(meet, "component").where("hops >= t_hops").select("component", "length", (F.col("a_hops") - F.col("hops")).alias("k"), "id")
    down = _above(nodes, meet.select("component", "end")).join(meet, "component").where("hops > t_hops").select("component", "length", (F.col("a_hops") - 2 * F.col("t_hops") + F.col("hops")).alias("k"), "id")
    found = stored(up.union(down), "paths")
    discard(nodes, one, trunk, tops, meet)
    return found


def _tops(hang: DataFrame) -> DataFrame:
    """``(id, top)``: the last node on the way up along ``above``."""
    now = stored(hang.select("id", F.coalesce("above", "id").alias("top")), "tops")
    while True:
        after = now
        for _ in range(2):
            ahead = after.select(F.col("id").alias("top"), F.col("top").alias("next"))
            after = after.join(ahead, "top").select("id", F.col("next").alias("top"))
        after = stored(after.join(now.select("id", F.col("top").alias("was")), "id"), "tops")
        moved = not after.where("top <> was").isEmpty()
        discard(now)
        now = after
        if not moved:
            return now.select("id", "top")
        now = after.drop("was")
        now._stored_at = after._stored_at


def peeled_paths(tree: DataFrame, components: DataFrame, least: float, least_nodes: int = 2) -> DataFrame:
    """``(component, path, k, id)``: the longest path of each tree, then those of what is left of it without that path, and so on, while they have ``least_nodes`` nodes and are ``least`` long.

    All pieces of all trees lose a path in a round. Paths are numbered by their nodes, the most first, then by their first node.
    """
    left = stored(tree.where("u <> v").join(components.select(F.col("id").alias("u"), F.col("component").alias("whole")), "u").select("u", "v", "w", "whole"), "left")
    taken = None
    while not left.isEmpty():
        pieces = stored(connected_components(left, "u", "v").withColumnRenamed("node", "id"), "pieces")
        paths = longest_paths(left, pieces).withColumn("n", F.count("*").over(Window.partitionBy("component")))
        paths = paths.where((F.col("length") >= least) & (F.col("n") >= least_nodes))
        gone = paths.select("component").distinct()
        wholes = left.select(F.col("u").alias("id"), "whole").distinct()
        first = F.min_by("id", "k").over(Window.partitionBy("component"))
        made = paths.withColumn("first", first)
        made = stored(made.join(pieces.select("id", "component"), ["id", "component"]).join(_whole(wholes, left), "id").select("whole", "component", "first", "n", "k", "id"), "peeled")
        taken = made if taken is None else taken.union(made)
        live = left.join(pieces.select(F.col("id").alias("u"), "component").join(gone, "component"), "u").select("u", "v", "w", "whole")
        live = live.join(made.select(F.col("id").alias("u")), "u", "left_anti").join(made.select(F.col("id").alias("v")), "v", "left_anti")
        rest = stored(live.select("u", "v", "w", "whole"), "left")
        discard(left, pieces)
        left = rest
    if taken is None:
        return tree.select(F.lit(0).cast("long").alias("component"), F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("k"), F.col("u").alias("id")).limit(0)
    heads = taken.where("k = 0").select("whole", "first", "n")
    number = F.row_number().over(Window.partitionBy("whole").orderBy(F.desc("n"), "first")) - 1
    numbered = heads.withColumn("path", number.cast("long")).select("whole", "first", "path")
    return taken.join(numbered, ["whole", "first"]).select(F.col("whole").alias("component"), "path", "k", "id")


def _whole(wholes: DataFrame, left: DataFrame) -> DataFrame:
    """``(id, whole)`` for both ends of the edges."""
    return wholes.union(left.select(F.col("v").alias("id"), "whole")).distinct()
