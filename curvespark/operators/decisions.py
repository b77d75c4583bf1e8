"""What to do at each junction of a forest, for all junctions at once: search, loop, cut, separate or skip, and the edits that follow.

A junction of three branches has a stem and two arms. If the smaller arm is short, it either comes back to the larger arm, which makes a loop, or it is cut. If
it is long, the stem leads to the next junction, and both are a crossing to separate; or it leads to none, and the nearest tip of another tree is searched.
Distances along trees come from ``paths``, so the published limits cost no rounds; distances in space are joins on grid cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators import paths
from curvespark.operators.cloud import AXES
from curvespark.operators.graph import proximity_edges, spanning_forest
from curvespark.operators.junctions import arcs, ball, sector_counts, stems, without_nodes
from curvespark.operators.trees import longest_paths, rooted
from curvespark.plans.lineage import stored

#: Fixed values of the published decisions: nodes of a real branch, the probe's radius, an arm's and a stem's edges, how far a tip may be, the share of the way back, a turn's least nodes, the most counted.
REAL, PROBE, LONG_ARM, STEM_HOPS, TIP_REACH, BACK, TURN, MOST = 20, 10.0, 1000, 1000, 50.0, 0.35, 3, 10_000
#: Fixed values of the separation: displacement, its ramp, and the edges of an arm that give its direction.
APART, RAMP, ARM_HOPS = 15.0, 75.0, 100
#: The edges of each arm that a deletion takes, and how far a new junction's old one may be.
DELETED_HOPS, OLD_REACH = 50, 100.0
#: Fixed value: how far along the tree a deletion at a node reaches.
PICK_REACH = 3.0


class Forest:
    """A forest ``(u, v, w)`` with what every decision asks of it: components, intervals, ancestors, branch sizes."""

    def __init__(self, tree: DataFrame, components: DataFrame) -> None:
        self.tree = tree
        self.nodes = rooted(tree, components)
        self.steps = paths.jumps(self.nodes)
        self.sizes = stored(paths.branch_sizes(tree, self.nodes), "sizes")

    def real_junctions(self, least: int = REAL) -> DataFrame:
        """``id`` of the nodes of three branches or more, all of over ``least`` nodes."""
        found = self.sizes.groupBy("junction").agg(F.count("*").alias("n"), F.min("size").alias("size"))
        return found.where((F.col("n") > 2) & (F.col("size") > least)).select(F.col("junction").alias("id"))


def _named(forest: Forest, cloud: DataFrame) -> DataFrame:
    """``(id, component, p*)`` of the forest's nodes, so that points of other trees aren't paired only to be left out."""
    return forest.nodes.select("id", "component").join(cloud.select("id", *(f"p{i}" for i in AXES)), "id")


def probes(forest: Forest, junctions: DataFrame, cloud: DataFrame, radius: float = PROBE) -> DataFrame:
    """``(junction, branch, node, v0..v2, far)``: of each branch the node whose distance from the junction is nearest to ``radius``, seen from there; ties go to the smaller id.

    Nodes beyond twice the radius are farther from it than the branch's first node can be, unless that one is itself farther away: it is always among those compared.
    """
    placed = _named(forest, cloud)
    at = placed.join(junctions.select("id"), "id", "left_semi")
    near = paths.on_branches(forest.nodes, ball(at, placed, 2 * radius, ("component",)).select(F.col("centre").alias("junction"), "id"), forest.sizes)
    first = forest.sizes.join(junctions.select(F.col("id").alias("junction")), "junction", "left_semi").select("junction", F.col("branch").alias("id"), "branch")
    rows = near.select("junction", "id", "branch").union(first).distinct()
    place = lambda name, p: cloud.select(F.col("id").alias(name), *(F.col(f"p{k}").alias(f"{p}{k}") for k in AXES))
    rows = rows.join(place("id", "q"), "id").join(place("junction", "j"), "junction").withColumns({f"v{k}": F.col(f"q{k}") - F.col(f"j{k}") for k in AXES})
    rows = rows.withColumn("far", F.sqrt(F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1") + F.col("v2") * F.col("v2")))
    best = F.min(F.struct(F.round(F.abs(F.col("far") - radius), 9).alias("off"), F.col("id").alias("node"), "v0", "v1", "v2", "far")).alias("b")
    return rows.groupBy("junction", "branch").agg(best).select("junction", "branch", "b.node", "b.v0", "b.v1", "b.v2", "b.far")


def arms(forest: Forest, junctions: DataFrame, cloud: DataFrame, reach: float = 4.0, probe: float = PROBE, long_arm: int = LONG_ARM) -> DataFrame:
    """``(junction, stem, short, long, depth, tip, touch)`` for those of ``junctions`` that have three branches with directions.

    ``short`` and ``long`` are the smaller and the larger arm (ties: the smaller id first), ``tip`` the smaller one's deepest node, ``depth`` edges away, ``touch`` the nearest
    node of the larger one within ``reach`` of it.
    """
    vectors = stored(probes(forest, junctions, cloud, probe), "vectors")
    scored = stems(vectors, sector_counts(vectors, cloud, probe)).select("junction", "branch", "is_stem")
    far = paths.branch_ends(forest.sizes, paths.reaches(forest.nodes, forest.steps)).select("junction", "branch", "size", F.col("far").alias("depth"), "end")
    rows = stored(scored.join(far, ["junction", "branch"]), "arms")
    order = F.row_number().over(Window.partitionBy("junction").orderBy("is_stem", "size", "branch"))
    pick = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    table = rows.withColumn("place", order).groupBy("junction").agg(pick(3, "branch").alias("stem"), pick(1, "branch").alias("short"), pick(2, "branch").alias("long"), pick(1, "depth").alias("depth"), pick(1, "end").alias("tip"))
    table = stored(table, "arms")

    placed = _named(forest, cloud)
    tips = placed.join(table.where(F.col("depth") <= long_arm).select(F.col("tip").alias("id")).distinct(), "id", "left_semi")
    near = table.join(ball(tips, placed, reach, ("component",)).select(F.col("centre").alias("tip"), "id", "d2"), "tip").where("id <> tip").select("junction", "long", "id", "d2")
    near = paths.on_branches(forest.nodes, near, forest.sizes).where(F.col("branch") == F.col("long"))
    touch = near.groupBy("junction").agg(F.min(F.struct(F.round("d2", 9).alias("d2"), "id")).alias("t")).select("junction", F.col("t.id").alias("touch"))

    return stored(table.join(touch, "junction", "left"), "touched")


def decide(forest: Forest, junctions: DataFrame, cloud: DataFrame, reach: float = 4.0, probe: float = PROBE, long_arm: int = LONG_ARM, stem_hops: int = STEM_HOPS, tip_reach: float = TIP_REACH) -> DataFrame:
    """``(junction, action, stem, short, long, tip, touch, next)`` for each of ``junctions``, which have three branches or more.

    The first columns are those of ``arms``. ``next`` is what the stem leads to: the next junction within ``stem_hops``, the loop's other junction, or the tip of another tree.
    Junctions of more than three branches, without directions, or where nothing is found are skipped.
    """
    table = arms(forest, junctions, cloud, reach, probe, long_arm)
    others = paths.branch_ends(forest.sizes, paths.reaches(forest.nodes, forest.steps, junctions, nearest=True)).where(F.col("far") <= stem_hops).select("junction", F.col("branch").alias("stem"), F.col("end").alias("ahead"))
    table = stored(table.join(others, ["junction", "stem"], "left"), "decided")
    turns = turning_points(forest, loop_nodes(forest, table.where(F.col("touch").isNotNull() & (F.col("depth") <= long_arm)))).select("junction", "other")
    lost = table.where((F.col("depth") > long_arm) & F.col("ahead").isNull())
    table = junctions.select(F.col("id").alias("junction")).join(table, "junction", "left").join(turns, "junction", "left")
    if lost.isEmpty():  # no stem to search from, so the trees' tips aren't asked for
        table = table.withColumn("loose", F.lit(None).cast(table.schema["tip"].dataType))
    else:
        table = table.join(search_links(forest, lost, cloud, stem_hops, tip_reach).select("junction", F.col("tip").alias("loose")), "junction", "left")
    is_long = F.col("depth") > long_arm
    action = (
        F.when(F.col("stem").isNull(), "skip")
        .when(is_long & F.col("ahead").isNotNull(), "separate")
        .when(is_long, F.when(F.col("loose").isNotNull(), "search").otherwise("skip"))
        .when(F.col("touch").isNull(), "cut")
        .otherwise(F.when(F.col("other").isNotNull(), "loop").otherwise("skip"))
    )
    ahead = F.when(is_long, F.coalesce("ahead", "loose")).otherwise(F.col("other"))
    return stored(table.select("junction", action.alias("action"), "stem", "short", "long", "tip", "touch", ahead.alias("next")), "decisions")


# --- loops ---------------------------------------------------------------------------


def loop_nodes(forest: Forest, table: DataFrame) -> DataFrame:
    """``(junction, k, id)``: the loop of each row ``(junction, tip, touch)`` in order, from the junction along the smaller arm to its tip, over to the larger arm and back to the junction."""
    wanted = table.select("junction", F.col("tip").alias("a"), F.col("touch").alias("b"))
    found = stored(paths.tree_paths(forest.nodes, forest.steps, wanted), "loops")
    rows = wanted.join(found, ["a", "b"])
    turn = rows.where("id = junction").select("junction", F.col("k").alias("turn"))
    rows = rows.join(turn, "junction").withColumn("last", F.max("k").over(Window.partitionBy("junction")))
    there = rows.where("k <= turn").select("junction", (F.col("turn") - F.col("k")).alias("k"), "id")
    back = rows.where("k >= turn").select("junction", (F.col("turn") + 1 + F.col("last") - F.col("k")).alias("k"), "id")
    return stored(there.union(back), "loop")


def turning_points(forest: Forest, loops: DataFrame, least: int = TURN, most: int = MOST) -> DataFrame:
    """``(junction, other, first, size)``: of each loop the node off which the largest tree of ``least`` nodes or more hangs, where it begins, and its size (up to ``most`` count); ties go to the smaller node."""
    rows = loops.where("id <> junction").select(F.col("junction").alias("j"), "id").distinct()
    off = rows.join(forest.sizes.select(F.col("junction").alias("id"), F.col("branch").alias("first"), "size"), "id").where(F.col("size") >= least)
    off = off.join(loops.select(F.col("junction").alias("j"), F.col("id").alias("first")), ["j", "first"], "left_anti")
    best = F.min(F.struct((-F.least("size", F.lit(most))).alias("less"), F.col("id").alias("other"), "first")).alias("m")
    return off.groupBy("j").agg(best).select(F.col("j").alias("junction"), "m.other", "m.first", (-F.col("m.less")).alias("size"))


def centrelines(loops: DataFrame, turns: DataFrame, cloud: DataFrame) -> DataFrame:
    """``(junction, k, p*)``: the middle between both halves of each loop from the junction to the other one, with as many points as the shorter half has nodes, evenly spaced along each."""
    rows = loops.join(turns.select("junction", "other"), "junction")
    at = rows.where("id = other").groupBy("junction").agg(F.min("k").alias("at"))
    rows = rows.join(at, "junction").join(cloud.select("id", *(f"p{i}" for i in AXES)), "id")
    end = F.max("k").over(Window.partitionBy("junction"))
    rows = rows.withColumn("end", end)
    halves = rows.where("k <= at").select("junction", F.lit(0).alias("half"), "k", *(f"p{i}" for i in AXES)).union(rows.where("k >= at").select("junction", F.lit(1), F.col("end") - F.col("k"), *(f"p{i}" for i in AXES)))
    counts = rows.groupBy("junction").agg(F.greatest(F.lit(2).cast("long"), F.least(F.first("at") + 1, F.first("end") - F.first("at") + 1)).alias("n"))
    even = _even(halves, counts)
    return even.groupBy("junction", "k").agg(*(F.avg(f"p{i}").alias(f"p{i}") for i in AXES))


def _even(halves: DataFrame, counts: DataFrame) -> DataFrame:
    """Each half as ``n`` points evenly spaced along it."""
    curves = halves.join(counts, "junction").select(F.struct("junction", "half").alias("sid"), "k", "n", *(f"p{i}" for i in AXES))
    by = Window.partitionBy("sid").orderBy("k")
    chord = F.sqrt(sum(((F.lead(f"p{i}").over(by) - F.col(f"p{i}")) * (F.lead(f"p{i}").over(by) - F.col(f"p{i}")) for i in AXES), F.lit(0.0)))
    rows = curves.withColumns({f"q{i}": F.lead(f"p{i}").over(by) for i in AXES} | {"chord": chord}).withColumn("stop", F.sum("chord").over(by)).withColumn("total", F.max("stop").over(Window.partitionBy("sid")))
    rows = rows.where("chord is not null").withColumn("begin", F.col("stop") - F.col("chord"))
    step = F.col("total") / (F.col("n") - 1)
    low, high = F.ceil(F.round(F.col("begin") / step, 9)), F.ceil(F.round(F.col("stop") / step, 9)) - 1
    high = F.when(F.col("stop") == F.col("total"), F.col("n") - 1).otherwise(high)
    rows = rows.where("total > 1e-9").withColumns({"low": low, "high": high}).where("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") * step - F.col("begin")) / F.col("chord")))
    return rows.where("chord > 1e-9").dropDuplicates(["sid", "k"]).select("sid.junction", "sid.half", F.col("k").cast("long").alias("k"), *((F.col(f"p{i}") + share * (F.col(f"q{i}") - F.col(f"p{i}"))).alias(f"p{i}") for i in AXES))


def apply_loops(forest: Forest, loops: DataFrame, turns: DataFrame, cloud: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """The forest's edges with each loop replaced by its centreline, and the new points ``(id, junction, p*)``, numbered from ``first_id``.

    Of loops that share a node, the one with the smallest junction is replaced in this round; the others wait. All edges at a loop's nodes go but those
    that lead away from its two junctions.
    """
    region = stored(loops.join(turns.select("junction", "other"), "junction").select("junction", "other", "id").distinct(), "region")
    owner = region.groupBy("id").agg(F.min("junction").alias("owner"))
    beaten = region.join(owner, "id").where("owner < junction").select("junction").distinct()
    region = stored(region.join(beaten, "junction", "left_anti"), "region")
    lines = centrelines(loops.join(region, "junction", "left_semi"), turns, cloud)
    last = F.max("k").over(Window.partitionBy("junction"))
    inner = stored(lines.withColumn("last", last).where("k > 0 and k < last"), "lines")
    counts = inner.groupBy("junction").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("junction").rowsBetween(Window.unboundedPreceding, -1))  # a row a loop
    start = counts.select("junction", F.coalesce(before, F.lit(0)).alias("start"))
    points = stored(inner.join(start, "junction").select((F.col("k") - 1 + F.col("start") + first_id).alias("id"), "junction", "k", *(f"p{i}" for i in AXES)), "points")

    mark = lambda end: region.select(F.col("id").alias(end), F.col("junction").alias(f"{end}_loop"), ((F.col("id") == F.col("junction")) | (F.col("id") == F.col("other"))).alias(f"{end}_gate"))
    edges = forest.tree.join(mark("u"), "u", "left").join(mark("v"), "v", "left")
    free = lambda end: F.col(f"{end}_loop").isNull() | F.col(f"{end}_gate")
    apart = F.col("u_loop").isNull() | F.col("v_loop").isNull() | (F.col("u_loop") != F.col("v_loop"))
    kept = edges.where(free("u") & free("v") & apart).select("u", "v", "w")

    gates = region.select("junction", "other").distinct()
    at = cloud.select("id", *(f"p{i}" for i in AXES))
    ends = gates.select("junction", F.col("junction").alias("id"), F.lit(0).cast("long").alias("k")).join(at, "id")
    ends = ends.unionByName(gates.join(counts, "junction", "left").select("junction", F.col("other").alias("id"), (F.coalesce("n", F.lit(0)) + 1).alias("k")).join(at, "id"))
    chain = ends.select("junction", "k", "id", *(f"p{i}" for i in AXES)).unionByName(points.select("junction", "k", "id", *(f"p{i}" for i in AXES)))
    by = Window.partitionBy("junction").orderBy("k")
    length = F.sqrt(sum(((F.lead(f"p{i}").over(by) - F.col(f"p{i}")) * (F.lead(f"p{i}").over(by) - F.col(f"p{i}")) for i in AXES), F.lit(0.0)))
    new = chain.select(F.col("id").alias("u"), F.lead("id").over(by).alias("v"), length.alias("w")).where("v is not null")
    return kept.unionByName(new), points.select("id", "junction", *(f"p{i}" for i in AXES))


# --- search --------------------------------------------------------------------------


def component_tips(forest: Forest) -> DataFrame:
    """``(component, id)``: both ends of each tree's longest path by edges."""
    even = forest.tree.select("u", "v", F.lit(1.0).alias("w"))
    way = longest_paths(even, forest.nodes.select("id", "component"))
    ends = way.groupBy("component").agg(F.min_by("id", "k").alias("a"), F.max_by("id", "k").alias("b"))
    return ends.select("component", F.explode(F.array("a", "b")).alias("id"))


def nearest_foreign(points: DataFrame, others: DataFrame, first: float) -> DataFrame:
    """``(id, other, distance)``: the nearest of ``others`` whose component differs, for each of ``points`` (both ``(id, component, p*)``); ties go to the smaller id.

    Points that found none within a radius look again within twice as much; the last radius spans everything.
    """
    sides = [F.max(f"p{i}") - F.min(f"p{i}") for i in AXES]
    both = points.select(*(f"p{i}" for i in AXES)).union(others.select(*(f"p{i}" for i in AXES)))
    most = both.agg(F.coalesce(F.sqrt(sum((s * s for s in sides), F.lit(0.0))), F.lit(0.0))).first()[0] + 1e-9
    left, radius, found = stored(points, "open"), first, None
    while True:
        near = ball(left, others, min(radius, most)).withColumnRenamed("id", "other")
        near = near.join(left.select(F.col("id").alias("centre"), "component"), "centre").join(others.select(F.col("id").alias("other"), F.col("component").alias("foreign")), "other").where("component <> foreign")
        hits = stored(near.groupBy("centre").agg(F.min(F.struct(F.round("d2", 9).alias("d2"), "other")).alias("m")).select(F.col("centre").alias("id"), "m.other", F.sqrt("m.d2").alias("distance")), "hits")
        found = hits if found is None else found.union(hits)
        left = stored(left.join(hits, "id", "left_anti"), "open")
        if radius >= most or left.isEmpty():
            return found
        radius *= 2


def search_links(forest: Forest, table: DataFrame, cloud: DataFrame, stem_hops: int = STEM_HOPS, tip_reach: float = TIP_REACH, back: float = BACK) -> DataFrame:
    """``(junction, tip, near, attach, hops, distance)`` for rows ``(junction, stem)``: the nearest tip of another tree, the stem's node nearest to it, and where it is attached.

    The stem reaches ``stem_hops`` + 1 edges; a tip farther than ``tip_reach`` from all of it is left alone. The attachment lies a share ``back`` of the way
    from that node to the junction, one edge short of it at most; ``distance`` is that between tip and attachment.
    """
    named = forest.nodes.select("id", "component")
    placed = cloud.select("id", *(f"p{i}" for i in AXES)).join(named, "id")
    at = placed.join(table.select(F.col("junction").alias("id")), "id", "left_semi")
    tips = placed.join(component_tips(forest).select("id").distinct(), "id", "left_semi")
    loose = nearest_foreign(at, tips, tip_reach).select(F.col("id").alias("junction"), F.col("other").alias("tip"))
    wanted = stored(table.select("junction", "stem").join(loose, "junction"), "wanted")
    near = ball(tips.join(wanted.select(F.col("tip").alias("id")).distinct(), "id", "left_semi"), placed, tip_reach).select(F.col("centre").alias("tip"), "id", "d2")
    rows = paths.on_branches(forest.nodes, wanted.join(near, "tip").select("junction", "stem", "tip", "id", "d2"), forest.sizes).where("branch = stem")
    rows = stored(rows.select("junction", "tip", "id", "d2"), "near")
    met = paths.common_ancestors(forest.nodes, forest.steps, rows.select(F.col("id").alias("a"), F.col("junction").alias("b")))
    hops = met.select(F.col("a").alias("id"), F.col("b").alias("junction"), (F.col("a_hops") + F.col("b_hops") - 2 * F.col("m_hops")).alias("hops"))
    best = rows.join(hops, ["id", "junction"]).where(F.col("hops") <= stem_hops + 1).groupBy("junction", "tip").agg(F.min(F.struct(F.round("d2", 9).alias("d2"), F.col("id").alias("near"), "hops")).alias("m"))
    best = stored(best.select("junction", "tip", "m.near", "m.hops"), "best")
    way = paths.tree_paths(forest.nodes, forest.steps, best.select(F.col("near").alias("a"), F.col("junction").alias("b")))
    target = F.least(F.bround(back * F.col("hops"), 0).cast("long"), F.col("hops") - 1)
    found = best.withColumn("target", target).join(way.select(F.col("a").alias("near"), F.col("b").alias("junction"), F.col("k").alias("target"), F.col("id").alias("attach")), ["near", "junction", "target"])
    place = lambda name, p: cloud.select(F.col("id").alias(name), *(F.col(f"p{i}").alias(f"{p}{i}") for i in AXES))
    found = found.join(place("tip", "a"), "tip").join(place("attach", "b"), "attach")
    distance = F.sqrt(sum(((F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in AXES), F.lit(0.0)))
    return stored(found.select("junction", "tip", "near", "attach", "hops", distance.alias("distance")), "links")


# --- separation ----------------------------------------------------------------------


def crossings_to_separate(forest: Forest, decisions: DataFrame) -> DataFrame:
    """``(junction, other, place, part, arm, start, id)``: the trunk's nodes in order (part 0) and all nodes of the four arms (part 1; arms 0 and 1 at the junction, 2 and 3 at the other one, by their first nodes).

    Of each tree the smallest junction to separate is taken, as a separation changes the tree; those without just two arms at both ends are left out.
    """
    wanted = decisions.where("action = 'separate'").select("junction", F.col("next").alias("other")).join(forest.nodes.select(F.col("id").alias("junction"), "component"), "junction")
    wanted = wanted.groupBy("component").agg(F.min(F.struct("junction", "other")).alias("m")).select("component", "m.junction", "m.other")
    trunk = stored(paths.tree_paths(forest.nodes, forest.steps, wanted.select(F.col("junction").alias("a"), F.col("other").alias("b"))).select(F.col("a").alias("junction"), F.col("b").alias("other"), "k", "id"), "trunk")
    ends = wanted.select("junction", "other", F.explode(F.array("junction", "other")).alias("end"))
    starts = ends.join(arcs(forest.tree).select(F.col("a").alias("end"), F.col("b").alias("start")), "end").join(trunk.select("junction", F.col("id").alias("start")), ["junction", "start"], "left_anti")
    place = F.row_number().over(Window.partitionBy("junction").orderBy(F.col("end") != F.col("junction"), "start")) - 1
    starts = starts.withColumns({"arm": place, "here": F.count(F.when(F.col("end") == F.col("junction"), 1)).over(Window.partitionBy("junction")), "all": F.count("*").over(Window.partitionBy("junction"))}).where("here = 2 and all = 4")
    starts = stored(starts.join(forest.sizes.select(F.col("junction").alias("end"), F.col("branch").alias("start"), "is_below"), ["end", "start"]), "starts")
    span = lambda name: forest.nodes.select(F.col("id").alias(name), F.col("component"), F.col("down").alias(f"{name}_down"), F.col("up").alias(f"{name}_up"))
    rows = starts.join(span("start"), "start").join(span("end").drop("component"), "end").join(span("id"), "component")
    under = lambda x: (F.col(f"{x}_down") >= F.col("id_down")) & (F.col(f"{x}_up") <= F.col("id_up"))
    arms = rows.where(F.when(F.col("is_below"), under("start")).otherwise(~under("end"))).select("junction", "other", F.lit(0).cast("long").alias("place"), F.lit(1).alias("part"), "arm", "start", "id")
    good = starts.select("junction").distinct()
    chain = trunk.join(good, "junction", "left_semi").select("junction", "other", F.col("k").alias("place"), F.lit(0).alias("part"), F.lit(-1).alias("arm"), F.lit(None).cast("long").alias("start"), "id")
    return stored(arms.unionByName(chain), "crossing")


def candidates(forest: Forest, crossing: DataFrame, cloud: DataFrame, original: DataFrame | None = None, apart: float = APART, ramp: float = RAMP, arm_hops: int = ARM_HOPS) -> DataFrame:
    """``(junction, candidate, id, strand, p*)``: the four ways (0 to 3) to pull each crossing apart along the second axis of its arms; strand 0 goes up, 1 down.

    Arms move in full at their junction and less along a smooth ramp; at each end one arm goes up and the other down, candidates 2 and 3 the other way round at the junction,
    1 and 3 at the other end. The trunk's nodes are split at the median of their places along the axis in the ``original`` cloud. The axis is that of the arms' means over ``arm_hops`` edges, and points to positive ``p1``.
    """
    at = cloud.select("id", *(f"p{i}" for i in AXES))
    first = (original if original is not None else cloud).select("id", *(F.col(f"p{i}").alias(f"o{i}") for i in AXES))
    end = F.when(F.col("arm") < 2, F.col("junction")).otherwise(F.col("other"))
    arms = stored(crossing.where("part = 1").withColumn("end", end).join(at, "id"), "arm_nodes")
    met = paths.common_ancestors(forest.nodes, forest.steps, arms.select(F.col("id").alias("a"), F.col("end").alias("b")))
    hops = met.select(F.col("a").alias("id"), F.col("b").alias("end"), (F.col("a_hops") + F.col("b_hops") - 2 * F.col("m_hops")).alias("hops"))
    means = arms.join(hops, ["id", "end"]).where(F.col("hops") <= arm_hops).groupBy("junction", "arm").agg(*(F.avg(f"p{i}").alias(f"m{i}") for i in AXES))
    gathered = means.groupBy("junction").agg(F.sort_array(F.collect_list(F.struct("arm", "m0", "m1", "m2"))).alias("means"))  # four rows a crossing

    def axes(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            out = []
            for junction, means in zip(rows["junction"], rows["means"], strict=True):
                m = np.array([[x["m0"], x["m1"], x["m2"]] for x in means])
                axis = np.linalg.svd(m - m.mean(0), full_matrices=False)[2][1]
                out.append((junction, *m.mean(0), *(axis if axis[1] >= 0 else -axis)))
            yield pd.DataFrame(out, columns=["junction", "c0", "c1", "c2", "x0", "x1", "x2"])

    axis = stored(gathered.mapInPandas(axes, "junction long, c0 double, c1 double, c2 double, x0 double, x1 double, x2 double"), "axes")
    ends = at.select(F.col("id").alias("end"), *(F.col(f"p{i}").alias(f"e{i}") for i in AXES))
    far = F.sqrt(sum(((F.col(f"p{i}") - F.col(f"e{i}")) * (F.col(f"p{i}") - F.col(f"e{i}")) for i in AXES), F.lit(0.0)))
    u = F.least(F.lit(1.0), far / ramp)
    which = F.explode(F.sequence(F.lit(0), F.lit(3)))
    moved = arms.join(ends, "end").join(axis, "junction").withColumn("weight", 1 - (3 * u * u - 2 * u * u * u)).withColumn("candidate", which)
    flipped = F.when(F.col("arm") < 2, F.col("candidate") >= 2).otherwise(F.col("candidate") % 2 == 1)
    up = (F.col("arm") % 2 == 0) != flipped
    step = F.when(up, F.col("weight")).otherwise(-F.col("weight")) * apart
    moved = moved.select("junction", "candidate", "id", F.when(up, 0).otherwise(1).alias("strand"), *((F.col(f"p{i}") + step * F.col(f"x{i}")).alias(f"p{i}") for i in AXES))
    trunk = crossing.where("part = 0").join(at, "id").join(first, "id", "left").join(axis, "junction")
    along = sum(((F.coalesce(f"o{i}", f"p{i}") - F.col(f"c{i}")) * F.col(f"x{i}") for i in AXES), F.lit(0.0))
    trunk = trunk.withColumn("along", along)
    middle = trunk.groupBy("junction").agg(F.percentile("along", F.lit(0.5)).alias("middle"))
    trunk = trunk.join(middle, "junction").withColumn("up", F.col("along") > F.col("middle")).withColumn("candidate", which)
    step = F.when(F.col("up"), F.lit(apart)).otherwise(F.lit(-apart))
    return moved.unionByName(trunk.select("junction", "candidate", "id", F.when(F.col("up"), 0).otherwise(1).alias("strand"), *((F.col(f"p{i}") + step * F.col(f"x{i}")).alias(f"p{i}") for i in AXES)))


def accept(forest: Forest, chosen: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """The forest's edges after separating, and the overrides ``(id, p*)`` of the nodes moved: ``chosen`` is one candidate of each crossing to accept.

    Only trees with a chosen crossing change: their nodes get the spanning forest of what is near at the new places; edges of all others stay.
    """
    moved = stored(chosen.select("id", *(f"p{i}" for i in AXES)), "moved")
    inside = moved.select("id")
    kept = forest.tree.join(inside.withColumnRenamed("id", "u"), "u", "left_anti").join(inside.withColumnRenamed("id", "v"), "v", "left_anti")
    new = spanning_forest(proximity_edges(moved, radius))
    return kept.select("u", "v", "w").unionByName(new.select("u", "v", "w")), moved


def bridges(forest: Forest, links: DataFrame, cloud: DataFrame, step: float = 0.1) -> DataFrame:
    """``(junction, k, p*)``: points about ``step`` apart on a smooth way from each link's tip to its attachment, without both, leaving along the neighbours that lie most nearly behind either."""
    at = lambda name, p: cloud.select(F.col("id").alias(name), *(F.col(f"p{i}").alias(f"{p}{i}") for i in AXES))
    rows = links.join(at("tip", "a"), "tip").join(at("attach", "b"), "attach")
    both = arcs(forest.tree)

    def outward(end: str, near: str, sign: int) -> DataFrame:
        beside = rows.join(both.select(F.col("a").alias(end), F.col("b").alias("beside")), end).join(at("beside", "n"), "beside")
        chord = sum(((F.col(f"n{i}") - F.col(f"{near}{i}")) * (F.col(f"b{i}") - F.col(f"a{i}")) for i in AXES), F.lit(0.0))
        best = beside.groupBy("junction").agg(F.min(F.struct(F.round(sign * chord, 9).alias("c"), "beside", *(f"n{i}" for i in AXES), *(f"{near}{i}" for i in AXES))).alias("m"))
        d = [F.col(f"m.{near}{i}") - F.col(f"m.n{i}") for i in AXES]
        size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + 1e-12
        return best.select("junction", *((d[i] / size).alias(f"{'s' if near == 'a' else 't'}{i}") for i in AXES))

    rows = rows.join(outward("tip", "a", 1), "junction").join(outward("attach", "b", -1), "junction")
    n = F.greatest(F.lit(1), F.bround(F.col("distance") / step, 0).cast("int") - 1)
    rows = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("u", F.col("k") / (F.col("n") + 1))
    x, y = F.col("u"), 1 - F.col("u")
    reach = 0.4 * F.col("distance")
    point = lambda i: y * y * y * F.col(f"a{i}") + 3 * y * y * x * (F.col(f"a{i}") + reach * F.col(f"s{i}")) + 3 * y * x * x * (F.col(f"b{i}") + reach * F.col(f"t{i}")) + x * x * x * F.col(f"b{i}")
    return rows.select("junction", "k", *(point(i).alias(f"p{i}") for i in AXES))


def delete_crossings(forest: Forest, crossing: DataFrame, cloud: DataFrame, hops: int = DELETED_HOPS) -> tuple[DataFrame, DataFrame]:
    """The forest's edges without each crossing's trunk and the first ``hops`` edges of its arms, and ``(junction, other, side, arm, id, p*)``: the nodes where its arms go on, on side 0 (the junction's) or 1."""
    arms = crossing.where("part = 1").withColumn("side", F.when(F.col("arm") < 2, 0).otherwise(1)).withColumn("end", F.when(F.col("side") == 0, F.col("junction")).otherwise(F.col("other")))
    met = paths.common_ancestors(forest.nodes, forest.steps, arms.select(F.col("id").alias("a"), F.col("end").alias("b")))
    far = met.select(F.col("a").alias("id"), F.col("b").alias("end"), (F.col("a_hops") + F.col("b_hops") - 2 * F.col("m_hops")).alias("hops"))
    rows = stored(arms.join(far, ["id", "end"]).select("junction", "other", "side", "arm", "id", "hops"), "arms")
    gone = stored(rows.where(F.col("hops") <= hops).select("id").union(crossing.where("part = 0").select("id")).distinct(), "gone")
    breaks = rows.where(F.col("hops") == hops + 1).join(gone, "id", "left_anti").join(cloud.select("id", *(f"p{i}" for i in AXES)), "id")
    return without_nodes(forest.tree, gone), breaks.select("junction", "other", "side", "arm", "id", *(f"p{i}" for i in AXES))


def pairings(breaks: DataFrame) -> DataFrame:
    """``(junction, way, a, b)``: both ways to join the two broken arms of one side to those of the other, by the smallest node of each; crossings with other numbers of arms have none."""
    firsts = breaks.groupBy("junction", "side", "arm").agg(F.min("id").alias("id"))
    place = F.row_number().over(Window.partitionBy("junction", "side").orderBy("arm")) - 1
    rows = firsts.withColumns({"place": place, "n": F.count("*").over(Window.partitionBy("junction", "side"))}).where("n = 2")
    one = rows.where("side = 0").select("junction", F.col("place").alias("i"), F.col("id").alias("a"))
    two = rows.where("side = 1").select("junction", F.col("place").alias("j"), F.col("id").alias("b"))
    return one.join(two, "junction").select("junction", F.when(F.col("i") == F.col("j"), 0).otherwise(1).alias("way"), "a", "b")


def midpoint_cuts(forest: Forest, before: DataFrame, after: DataFrame, cloud: DataFrame, reach: float = OLD_REACH, decided: DataFrame | None = None) -> DataFrame:
    """``(junction, target, distance, u, v)``: the edge to cut half way, by length, between a new junction and the old one nearest to it.

    ``before`` and ``after`` are junctions (``id``); new ones are in ``after`` alone, old ones in both. Of the new junctions whose nearest old one within ``reach`` is the same, the nearest is cut off (ties:
    the smaller id), if a path joins them. Nothing is cut if ``decided`` says that any new junction is to separate.
    """
    new, old = after.join(before, "id", "left_anti"), after.join(before, "id", "left_semi")
    if decided is not None and not decided.join(new.withColumnRenamed("id", "junction"), "junction", "left_semi").where("action = 'separate'").isEmpty():
        new = new.limit(0)
    at = cloud.select("id", *(f"p{i}" for i in AXES))
    near = ball(at.join(new, "id", "left_semi"), at.join(old, "id", "left_semi"), reach).withColumn("d2", F.round("d2", 9))
    near = near.groupBy("centre").agg(F.min(F.struct("d2", "id")).alias("m")).select("m.d2", F.col("centre").alias("junction"), F.col("m.id").alias("target"))
    won = stored(near.groupBy("target").agg(F.min(F.struct("d2", "junction")).alias("m")).select("m.junction", "target", F.sqrt("m.d2").alias("distance")), "won")
    named = forest.nodes.select(F.col("id").alias("junction"), "component")
    same = won.join(named, "junction").join(named.withColumnsRenamed({"junction": "target", "component": "c"}), "target").where("component = c")
    way = paths.tree_paths(forest.nodes, forest.steps, same.select(F.col("junction").alias("a"), F.col("target").alias("b"))).join(at, "id")
    by = Window.partitionBy("a", "b").orderBy("k")
    step = F.sqrt(sum(((F.lead(f"p{i}").over(by) - F.col(f"p{i}")) * (F.lead(f"p{i}").over(by) - F.col(f"p{i}")) for i in AXES), F.lit(0.0)))
    way = way.withColumns({"v": F.lead("id").over(by), "step": step}).withColumn("stop", F.sum("step").over(by)).withColumn("half", F.max("stop").over(Window.partitionBy("a", "b")) / 2)
    cut = way.where("v is not null and stop >= half").groupBy("a", "b").agg(F.min(F.struct("k", "id", "v")).alias("m"))
    return same.join(cut.select(F.col("a").alias("junction"), F.col("b").alias("target"), F.col("m.id").alias("u"), "m.v"), ["junction", "target"]).select("junction", "target", "distance", "u", "v")


def walked_to(forest: Forest, picks: DataFrame, cloud: DataFrame, reach: float = PICK_REACH) -> DataFrame:
    """``(pick, id, length)``: the nodes no farther than ``reach`` along the tree from each of ``picks`` (``id``), itself included. None of them is farther in space, so only those near are measured."""
    here = forest.nodes.select("id", "component")
    at = cloud.select("id", *(f"p{i}" for i in AXES))
    near = ball(at.join(picks.select("id"), "id", "left_semi"), at.join(here, "id", "left_semi"), reach).select(F.col("centre").alias("pick"), "id")
    same = near.join(here, "id").join(here.withColumnsRenamed({"id": "pick", "component": "c"}), "pick").where("component = c").select("pick", "id")
    met = paths.common_ancestors(forest.nodes, forest.steps, same.select(F.col("pick").alias("a"), F.col("id").alias("b")))
    far = forest.nodes.select("id", "far")
    for name in ("a", "b", "meet"):
        met = met.join(far.withColumnsRenamed({"id": name, "far": f"{name}_far"}), name)
    rows = met.select(F.col("a").alias("pick"), F.col("b").alias("id"), (F.col("a_far") + F.col("b_far") - 2 * F.col("meet_far")).alias("length"))
    return rows.where(F.round("length", 9) <= reach)


def smaller_sides(forest: Forest, picks: DataFrame) -> DataFrame:
    """``(pick, branch, id)``: the nodes of the smallest branch of each of ``picks`` (``id``; ties: the smaller first node), without the pick itself."""
    order = F.row_number().over(Window.partitionBy("junction").orderBy("size", "branch"))
    small = forest.sizes.join(picks.select(F.col("id").alias("junction")).distinct(), "junction", "left_semi").withColumn("place", order).where("place = 1")
    span = lambda name: forest.nodes.select(F.col("id").alias(name), "component", F.col("down").alias(f"{name}_down"), F.col("up").alias(f"{name}_up"))
    rows = small.select("junction", "branch", "is_below").join(span("junction"), "junction").join(span("branch").drop("component"), "branch").join(span("id"), "component")
    under = lambda x: (F.col(f"{x}_down") >= F.col("id_down")) & (F.col(f"{x}_up") <= F.col("id_up"))
    return rows.where(F.when(F.col("is_below"), under("branch")).otherwise(~under("junction"))).select(F.col("junction").alias("pick"), "branch", "id")
