"""Junctions of trees: their branches, which of three is the stem, short arms and tangles to cut, and edits of what is left.

Trees are edge lists ``(u, v, w)`` without cycles, of any number of components. Branches are walked by all junctions at once, one hop a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES, cell, cells_within
from curvespark.plans.lineage import discard, stored

#: The weight of density against angles when the stem is chosen.
DENSITY_WEIGHT = 0.6


def arcs(tree: DataFrame) -> DataFrame:
    """``(a, b)`` for each edge in both directions."""
    return tree.select(F.col("u").alias("a"), F.col("v").alias("b")).union(tree.select("v", "u"))


def hubs(tree: DataFrame, least: int = 3) -> DataFrame:
    """``id`` of the nodes with ``least`` edges or more."""
    return arcs(tree).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree")).where(F.col("degree") >= least).select("id")


def branches(tree: DataFrame, junctions: DataFrame, hops: int) -> DataFrame:
    """``(junction, branch, node, hops)``: the nodes of each branch of each junction up to ``hops`` edges away; a branch is named by its first node.

    Each round adds the nodes one edge farther out, stored in the shared folder, and stops when there are none. A tree has one way to each node, so none is
    met twice; the rows of all rounds are the result, so ask for no more hops than are needed.
    """
    both = stored(arcs(tree), "arcs")
    now = junctions.select(F.col("id").alias("junction")).join(both, F.col("junction") == F.col("a")).select("junction", F.col("b").alias("branch"), F.col("b").alias("node"), F.lit(1).alias("hops"), F.col("a").alias("before"))
    now = stored(now, "front")
    out, at, fronts = now, 1, [now]
    while at < hops and not now.isEmpty():
        at += 1
        step = now.join(both, (F.col("node") == F.col("a")) & (F.col("b") != F.col("before")))
        now = stored(step.select("junction", "branch", F.col("b").alias("node"), F.lit(at).alias("hops"), F.col("a").alias("before")), "front")
        out = out.union(now)
        fronts.append(now)
    found = stored(out.select("junction", "branch", "node", "hops"), "branches")
    discard(both, *fronts)
    return found


def branch_sizes(found: DataFrame) -> DataFrame:
    """``(junction, branch, size, depth)`` of the branches as far as they were walked."""
    return found.groupBy("junction", "branch").agg(F.count("*").alias("size"), F.max("hops").alias("depth"))


def real_junctions(tree: DataFrame, least: int = 20) -> DataFrame:
    """``id`` of nodes with three branches or more, all of them of over ``least`` nodes; ``least + 1`` hops are enough to tell."""
    sizes = branch_sizes(branches(tree, hubs(tree), least + 1))
    return sizes.groupBy("junction").agg(F.min("size").alias("size")).where(F.col("size") > least).select(F.col("junction").alias("id"))


def largest_branches(found: DataFrame, most: int = 5) -> DataFrame:
    """``(junction, place, branch, size)``: the ``most`` largest branches of each junction (ties: the smaller first node)."""
    place = F.row_number().over(Window.partitionBy("junction").orderBy(F.desc("size"), "branch"))
    return branch_sizes(found).withColumn("place", place).where(F.col("place") <= most).select("junction", "place", "branch", "size")


def next_junctions(found: DataFrame, junctions: DataFrame) -> DataFrame:
    """``(junction, branch, next, hops)``: the nearest other junction on each branch, by edges and then by id; branches without one are left out."""
    others = found.join(junctions.select(F.col("id").alias("node")), "node", "left_semi")
    return others.groupBy("junction", "branch").agg(F.min(F.struct("hops", F.col("node").alias("next"))).alias("n")).select("junction", "branch", "n.next", "n.hops")


def _positions(cloud: DataFrame, name: str, prefix: str, more: tuple[str, ...] = ()) -> DataFrame:
    return cloud.select(F.col("id").alias(name), *(F.col(f"p{k}").alias(f"{prefix}{k}") for k in AXES), *more)


def places(found: DataFrame, cloud: DataFrame) -> DataFrame:
    """The cloud's points that are a junction or a node of its branches, stored: positions of these are then looked up in that table, and the cloud is sent by its ids once."""
    ids = found.select(F.col("node").alias("id")).union(found.select("junction")).distinct()
    return stored(cloud.select("id", *(f"p{k}" for k in AXES)).join(ids, "id", "left_semi"), "places")


def probe_vectors(found: DataFrame, cloud: DataFrame, radius: float = 10.0) -> DataFrame:
    """``(junction, branch, node, v0..v2, far)``: of each branch the node whose distance from the junction is nearest to ``radius``, seen from there (ties: fewer hops, then the smaller id)."""
    rows = found.join(_positions(cloud, "node", "q"), "node").join(_positions(cloud, "junction", "j"), "junction")
    rows = rows.withColumns({f"v{k}": F.col(f"q{k}") - F.col(f"j{k}") for k in AXES})
    rows = rows.withColumn("far", F.sqrt(F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1") + F.col("v2") * F.col("v2")))
    best = F.min(F.struct(F.abs(F.col("far") - radius).alias("off"), "hops", "node", "v0", "v1", "v2", "far")).alias("b")
    return rows.groupBy("junction", "branch").agg(best).select("junction", "branch", "b.node", "b.v0", "b.v1", "b.v2", "b.far")


def ball(centres: DataFrame, cloud: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``(centre, id, d2, r0..r2)``: the points within ``radius`` of each centre ``(id, p*)`` and where they are from it, by an equi-join on grid cells; only points whose ``by`` columns are the centre's, if there are such.

    Centres are copied into the cells that their radius reaches, so let them be the fewer; both sides are sorted, as Spark would broadcast the copies by their table's size.
    """
    a = _positions(centres, "centre", "j", by)
    for k in AXES:
        a = a.withColumn(f"c{k}", F.explode(cells_within(f"j{k}", radius)))
    b = _positions(cloud, "id", "q", by).withColumns({f"c{k}": cell(f"q{k}", radius) for k in AXES})
    near = a.join(b.hint("merge"), ["c0", "c1", "c2", *by]).withColumns({f"r{k}": F.col(f"q{k}") - F.col(f"j{k}") for k in AXES})
    near = near.withColumn("d2", F.col("r0") * F.col("r0") + F.col("r1") * F.col("r1") + F.col("r2") * F.col("r2")).where(F.col("d2") <= radius * radius)
    return near.select("centre", "id", "d2", *(f"r{k}" for k in AXES))


def sector_counts(vectors: DataFrame, cloud: DataFrame, radius: float = 10.0, at: DataFrame | None = None) -> DataFrame:
    """``(junction, branch, points)``: the points about each junction within ``radius``, each counted for the branch that it lies most nearly along (ties: the smaller branch); the junction's own place isn't counted. ``at`` may give the junctions' points, see ``places``."""
    centres = (cloud if at is None else at).join(vectors.select(F.col("junction").alias("id")).distinct(), "id", "left_semi")
    near = ball(centres, cloud, radius).where("d2 > 1e-12").withColumnRenamed("centre", "junction")
    lean = (F.col("r0") * F.col("v0") + F.col("r1") * F.col("v1") + F.col("r2") * F.col("v2")) / F.col("far")
    best = near.join(vectors.where("far > 1e-9"), "junction").groupBy("junction", "id").agg(F.max(F.struct(lean.alias("lean"), (-F.col("branch")).alias("b"))).alias("m"))
    counted = best.groupBy("junction", (-F.col("m.b")).alias("branch")).agg(F.count("*").alias("points"))
    return vectors.select("junction", "branch").join(counted, ["junction", "branch"], "left").select("junction", "branch", F.coalesce("points", F.lit(0)).alias("points"))


def stems(vectors: DataFrame, counts: DataFrame, weight: float = DENSITY_WEIGHT) -> DataFrame:
    """``(junction, branch, angle, density, score, is_stem)`` for junctions of three branches: the stem is the branch of the highest score.

    ``angle`` is 180 degrees less the angle between the other two, ``density`` the points in the branch's sector, both as shares of the junction's sums (a third each where these are zero).
    """
    rows = vectors.join(counts, ["junction", "branch"])
    three = Window.partitionBy("junction")
    rows = rows.withColumns({"n": F.count("*").over(three), "short": F.min("far").over(three)}).where("n = 3 and short > 1e-9")
    unit = {f"u{k}": F.col(f"v{k}") / F.col("far") for k in AXES}
    rows = rows.withColumns(unit).select("junction", "branch", "points", "u0", "u1", "u2")
    a, b = (rows.select("junction", F.col("branch").alias(f"{s}_branch"), *(F.col(f"u{k}").alias(f"{s}{k}") for k in AXES)) for s in "ab")
    cos = F.col("a0") * F.col("b0") + F.col("a1") * F.col("b1") + F.col("a2") * F.col("b2")
    between = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    pairs = a.join(b, "junction").where("a_branch < b_branch").select("junction", "a_branch", "b_branch", (180.0 - between).alias("left_over"))
    rows = rows.join(pairs, "junction").where((F.col("branch") != F.col("a_branch")) & (F.col("branch") != F.col("b_branch")))
    share = lambda c, least: F.when(F.sum(c).over(three) > least, F.col(c) / F.sum(c).over(three)).otherwise(F.lit(1.0 / 3.0))
    rows = rows.withColumns({"angle": share("left_over", 1e-9), "density": share("points", 0)})
    rows = rows.withColumn("score", (1 - weight) * F.col("angle") + weight * F.col("density"))
    first = F.row_number().over(three.orderBy(F.desc(F.round("score", 9)), "branch"))
    return rows.select("junction", "branch", "angle", "density", "score", (first == 1).alias("is_stem"))


def short_arms(found: DataFrame, stem: DataFrame, cloud: DataFrame, near: float = 4.0) -> DataFrame:
    """``(junction, branch, tip)`` of arms to cut: the smaller of a junction's two arms, if no node of the larger one lies within ``near`` of the smaller one's deepest node.

    Sizes are as far as the branches were walked; ties go to the smaller branch, of equally deep nodes to the smaller id. Of the cloud only the branches' nodes count: ``places`` are enough.
    """
    arms = found.join(stem.where("not is_stem").select("junction", "branch"), ["junction", "branch"])
    tip = F.min(F.struct((-F.col("hops")).alias("deep"), "node")).alias("t")
    sizes = arms.groupBy("junction", "branch").agg(F.count("*").alias("size"), tip)
    order = F.row_number().over(Window.partitionBy("junction").orderBy("size", "branch"))
    small = sizes.withColumn("place", order).where("place = 1").select("junction", "branch", F.col("t.node").alias("tip"))
    tips = cloud.join(small.select(F.col("tip").alias("id")).distinct(), "id", "left_semi")
    close = ball(tips, cloud, near).select(F.col("centre").alias("tip"), F.col("id").alias("node"))
    others = arms.select("junction", F.col("branch").alias("other"), "node")
    bridged = small.join(close, "tip").join(others, ["junction", "node"]).where("other <> branch").select("junction").distinct()
    return small.join(bridged, "junction", "left_anti")


def without_nodes(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that touch none of ``nodes`` (``id``)."""
    left = tree.join(nodes.select(F.col("id").alias("u")), "u", "left_anti")
    return left.join(nodes.select(F.col("id").alias("v")), "v", "left_anti").select(*tree.columns)


def cut_tangles(tree: DataFrame, junctions: DataFrame, hops: int = 50) -> tuple[DataFrame, DataFrame]:
    """Edges without the junctions and what lies within ``hops`` edges of them, and ``(junction, branch, node)``: where each branch goes on."""
    found = branches(tree, junctions, hops + 1)
    gone = found.where(F.col("hops") <= hops).select(F.col("node").alias("id")).union(junctions.select("id")).distinct()
    breaks = found.where(F.col("hops") == hops + 1).join(gone.select(F.col("id").alias("node")), "node", "left_anti")
    return without_nodes(tree, gone), breaks.select("junction", "branch", "node")


def overridden(cloud: DataFrame, overrides: DataFrame, deleted: DataFrame) -> DataFrame:
    """The cloud at its edited places: ``overrides`` (id, p*, and ``at``, the order in which they were written, if an id may have several) replace positions, ``deleted`` ids go.

    The last of an id's overrides counts; of those written at the same time, or without an order, the largest position.
    """
    written = ["at"] if "at" in overrides.columns else []
    new = overrides.groupBy("id").agg(F.max(F.struct(*written, *(f"p{k}" for k in AXES))).alias("o"))
    moved = cloud.join(new, "id", "left").withColumns({f"p{k}": F.coalesce(F.col(f"o.p{k}"), F.col(f"p{k}")) for k in AXES})
    return moved.join(deleted.select("id"), "id", "left_anti").select(*cloud.columns)


def without_curve(curves: DataFrame, labels: DataFrame, sid: int) -> tuple[DataFrame, DataFrame]:
    """Curves but one, and labels ``(id, label)`` whose points of that curve's component, which has its number, are -1."""
    gone: Column = F.when(F.col("label") == sid, F.lit(-1)).otherwise(F.col("label"))
    return curves.where(F.col("sid") != sid), labels.withColumn("label", gone)


def nearest_ends(points: DataFrame, curves: DataFrame, reach: float) -> DataFrame:
    """``(id, sid, end, distance)``: the nearest end of a curve of two points or more within ``reach`` of each point (ties: the smaller curve, then its start, 0); points without one are left out."""
    first, last = (f(F.struct("k", *(f"p{k}" for k in AXES))) for f in (F.min, F.max))
    ends = curves.groupBy("sid").agg(F.count("*").alias("n"), first.alias("a"), last.alias("b")).where("n > 1")
    ends = ends.select("sid", F.posexplode(F.array("a", "b")).alias("end", "e")).select(F.struct("sid", "end").alias("id"), *(F.col(f"e.p{k}").alias(f"p{k}") for k in AXES))
    near = ball(ends, points, reach)  # curves have many points and two ends
    best = near.groupBy("id").agg(F.min(F.struct("d2", "centre.sid", "centre.end")).alias("m"))
    return best.select("id", "m.sid", "m.end", F.sqrt("m.d2").alias("distance"))
