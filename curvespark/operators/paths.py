"""Ways through forests for many pairs at once: ancestors at powers of two, lowest common ancestors, paths, and what lies farthest or nearest along each branch.

All of it works on the walk's intervals of ``trees.rooted``: a node is above another where its interval holds the other's. Rounds follow the logarithm of a
tree's depth, never the number of hops, and rows follow the nodes and what is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.junctions import arcs
from curvespark.plans.lineage import discard, stored


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """``(id, to)`` for each power of two: the ancestor so many edges up, for the nodes that have one."""
    table = stored(nodes.where("parent is not null").select("id", F.col("parent").alias("to")), "jump")
    out = []
    while not table.isEmpty():
        out.append(table)
        ahead = table.select(F.col("id").alias("to"), F.col("to").alias("next"))
        table = stored(table.join(ahead, "to").select("id", F.col("next").alias("to")), "jump")
    discard(table)
    return out


def _span(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.select(F.col("id").alias(f"{prefix}"), F.col("down").alias(f"{prefix}_down"), F.col("up").alias(f"{prefix}_up"), F.col("hops").alias(f"{prefix}_hops"))


def _holds(upper: str, lower: str) -> Column:
    """Whether one node is above the other, or is it."""
    return (F.col(f"{upper}_down") >= F.col(f"{lower}_down")) & (F.col(f"{upper}_up") <= F.col(f"{lower}_up"))


def common_ancestors(nodes: DataFrame, steps: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """``(a, b, meet, a_hops, b_hops, m_hops)``: the lowest node above both nodes of each pair ``(a, b)`` of a tree, and their distances from the root in edges."""
    ends = pairs.select("a", "b").distinct().join(_span(nodes, "a"), "a").join(_span(nodes, "b"), "b")
    now = stored(ends.withColumns({"m": F.col("a"), "m_down": F.col("a_down"), "m_up": F.col("a_up")}), "meeting")
    span = nodes.select(F.col("id").alias("to"), F.col("down").alias("t_down"), F.col("up").alias("t_up"))
    for table in reversed(steps):
        up = now.join(table.withColumnRenamed("id", "m"), "m", "left").join(span, "to", "left")
        go = F.col("to").isNotNull() & ~((F.col("t_down") >= F.col("b_down")) & (F.col("t_up") <= F.col("b_up"))) & ~_holds("m", "b")
        moved = up.select("a", "b", *(f"{e}_{c}" for e in "ab" for c in ("down", "up", "hops")), *(F.when(go, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("to", "m"), ("t_down", "m_down"), ("t_up", "m_up"))))
        after = stored(moved, "meeting")
        discard(now)
        now = after
    last = now.join(nodes.select(F.col("id").alias("m"), "parent"), "m").withColumn("meet", F.when(_holds("m", "b"), F.col("m")).otherwise(F.col("parent")))
    return last.join(nodes.select(F.col("id").alias("meet"), F.col("hops").alias("m_hops")), "meet").select("a", "b", "meet", "a_hops", "b_hops", "m_hops")


def _upward(steps: list[DataFrame], starts: DataFrame) -> DataFrame:
    """``(key, node, at)``: the first ``most + 1`` nodes on the way up from each ``node`` of ``(key, node, most)``; each round halves the stretches that rows stand for."""
    now = starts.select("key", "node", F.lit(0).cast("long").alias("at"), F.col("most").cast("long").alias("most"))
    for power in reversed(range(len(steps))):
        far = now.where(F.col("at") + (1 << power) <= F.col("most")).join(steps[power].withColumnRenamed("id", "node"), "node")
        now = stored(now.union(far.select("key", F.col("to").alias("node"), (F.col("at") + (1 << power)).alias("at"), "most")), "upward")
    return now.select("key", "node", "at")


def tree_paths(nodes: DataFrame, steps: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """``(a, b, k, id)``: the nodes of the path from ``a`` to ``b`` in order, both included; a pair of one node has that one."""
    met = stored(common_ancestors(nodes, steps, pairs), "met")
    key = F.struct("a", "b")
    rise = _upward(steps, met.select(key.alias("key"), F.col("a").alias("node"), (F.col("a_hops") - F.col("m_hops")).alias("most")))
    fall = _upward(steps, met.select(key.alias("key"), F.col("b").alias("node"), (F.col("b_hops") - F.col("m_hops") - 1).alias("most")).where("most >= 0"))
    length = met.select(key.alias("key"), (F.col("a_hops") + F.col("b_hops") - 2 * F.col("m_hops")).alias("length"))
    fall = fall.join(length, "key").select("key", "node", (F.col("length") - F.col("at")).alias("k"))
    return rise.select("key", "node", F.col("at").alias("k")).union(fall).select("key.a", "key.b", "k", F.col("node").alias("id"))


def reaches(nodes: DataFrame, steps: list[DataFrame], marked: DataFrame | None = None, nearest: bool = False) -> DataFrame:
    """``(id, below, below_node, above, above_node)``: of the marked nodes (all if None) the farthest, or nearest, at or under each node and anywhere else in its tree, by edges from there.

    Ties go to the smaller node; null where there is none. Extremes come up from descendants over doubling distances, and go down as the best of all turns
    off the way to the root, again over doubling distances.
    """
    sign = 1 if nearest else -1
    own = nodes.select("id", "parent", "hops")
    if marked is not None:
        own = own.join(marked.select("id", F.lit(True).alias("is_marked")), "id", "left")
    else:
        own = own.withColumn("is_marked", F.lit(True))
    own = stored(own.withColumn("own", F.when(F.col("is_marked"), F.struct((sign * F.col("hops")).alias("d"), F.col("id").alias("node")))).drop("is_marked"), "own")
    best, before = own.select("id", "hops", F.col("own").alias("best")), None
    for power, table in enumerate(steps):  # a node less deep than a step is long takes no part in it
        more = best.where((F.col("hops") >= 1 << power) & F.col("best").isNotNull()).join(table, "id").groupBy(F.col("to").alias("id")).agg(F.min("best").alias("more"))
        best = stored(best.join(more, "id", "left").select("id", "hops", F.least("best", "more").alias("best")), "below")
        discard(before)
        before = best
    rows = stored(own.join(best.drop("hops"), "id"), "branches")
    beside = Window.partitionBy("parent").orderBy(F.asc_nulls_last("best"), "id")
    whole = beside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = rows.where("parent is not null").withColumns({"place": F.row_number().over(beside), "one": F.first("best").over(whole), "two": F.nth_value("best", 2).over(whole)})
    above = own.select(F.col("id").alias("parent"), F.col("own").alias("at_parent"), F.col("hops").alias("p_hops"))
    turns = turns.join(above, "parent").withColumn("turn", F.least(F.when(F.col("place") == 1, F.col("two")).otherwise(F.col("one")), "at_parent"))
    start = turns.select("id", F.when(F.col("turn").isNotNull(), F.struct((F.col("turn.d") - 2 * sign * F.col("p_hops")).alias("d"), F.col("turn.node").alias("node"))).alias("turn"))
    turn = stored(own.select("id", "hops").join(start, "id", "left"), "above")
    for power, table in enumerate(steps):
        ahead = turn.select(F.col("id").alias("to"), F.col("turn").alias("more"))
        deep = turn.where(F.col("hops") >= 1 << power).join(table, "id").join(ahead, "to").select("id", "hops", F.least("turn", "more").alias("turn"))
        after = stored(deep.union(turn.where(F.col("hops") < 1 << power)), "above")
        discard(turn)
        turn = after
    out = rows.join(turn.drop("hops"), "id")
    return stored(
        out.select(
            "id", (sign * F.col("best.d") - F.col("hops")).alias("below"), F.col("best.node").alias("below_node"),
            (sign * F.col("turn.d") + F.col("hops")).alias("above"), F.col("turn.node").alias("above_node"),
        ), "reaches",
    )


def branch_sizes(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(junction, branch, is_below, size)`` for each edge of each node both ways: the nodes beyond it, from the intervals alone."""
    whole = nodes.where("parent is null").select("component", ((F.col("down") - F.col("up") + 1) / 2).cast("long").alias("whole"))
    span = nodes.select("id", "parent", "component", ((F.col("down") - F.col("up") + 1) / 2).cast("long").alias("under"))
    both = arcs(tree).select(F.col("a").alias("junction"), F.col("b").alias("branch"))
    rows = both.join(span.select(F.col("id").alias("junction"), F.col("parent").alias("j_parent"), F.col("under").alias("j_under"), "component"), "junction")
    rows = rows.join(span.select(F.col("id").alias("branch"), "under"), "branch").join(whole, "component")
    is_below = F.coalesce(F.col("branch") != F.col("j_parent"), F.lit(True))
    return rows.select("junction", "branch", is_below.alias("is_below"), F.when(is_below, F.col("under")).otherwise(F.col("whole") - F.col("j_under")).alias("size"))


def branch_ends(sizes: DataFrame, reach: DataFrame) -> DataFrame:
    """``sizes`` with ``far`` and ``end``: what ``reaches`` found on each branch and how many edges from the junction."""
    below = reach.select(F.col("id").alias("branch"), (F.col("below") + 1).alias("b_far"), F.col("below_node").alias("b_end"))
    above = reach.select(F.col("id").alias("junction"), F.col("above").alias("a_far"), F.col("above_node").alias("a_end"))
    rows = sizes.join(below, "branch").join(above, "junction")
    side = lambda a, b: F.when(F.col("is_below"), F.col(b)).otherwise(F.col(a))
    return rows.select(*sizes.columns, side("a_far", "b_far").alias("far"), side("a_end", "b_end").alias("end"))


def on_branches(nodes: DataFrame, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pairs`` ``(junction, id, ...)`` of nodes of one tree with the ``branch`` of the junction that leads to the node; pairs of other trees and of a node with itself are left out."""
    j = nodes.select(F.col("id").alias("junction"), F.col("component").alias("j_component"), F.col("down").alias("j_down"), F.col("up").alias("j_up"), "parent")
    y = nodes.select("id", "component", "down", "up")
    rows = pairs.join(j, "junction").join(y, "id").where("component = j_component and id <> junction")
    beyond = ~((F.col("j_down") >= F.col("down")) & (F.col("j_up") <= F.col("up")))
    outside = rows.where(beyond).select(*pairs.columns, F.col("parent").alias("branch"))
    child = sizes.where("is_below").select("junction", "branch").join(nodes.select(F.col("id").alias("branch"), F.col("down").alias("c_down"), F.col("up").alias("c_up")), "branch")
    inside = rows.where(~beyond).join(child, "junction").where((F.col("c_down") >= F.col("down")) & (F.col("c_up") <= F.col("up")))
    return outside.union(inside.select(*pairs.columns, "branch"))
