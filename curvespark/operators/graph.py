"""Proximity graphs: components, spanning forests, degrees, and paths in trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import neighbours
from curvespark.operators.components import connected_components
from curvespark.plans.lineage import discard, stored


def proximity_edges(cloud: DataFrame, radius: float) -> DataFrame:
    """``(u, v, w)`` for pairs no farther apart than the radius."""
    return neighbours(cloud, radius, half=True).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), F.sqrt("d2").alias("w"))


def labelled_components(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """``(id, component, size, label)``: components of ``least`` nodes or more, labelled from 0 by size and then by smallest node."""
    found = connected_components(edges, "u", "v").withColumnRenamed("node", "id")
    all_nodes = nodes.select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = all_nodes.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    # sizes differ far less than components do: how many components are larger, then the place among those as large
    of_size = sizes.groupBy("size").agg(F.count("*").alias("n"))
    larger = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a size
    ranked = sizes.join(of_size.select("size", larger.alias("larger")), "size")
    first = ranked.where("size = 1").select("component", "size", "larger")
    rest = ranked.where("size > 1").withColumn("label", F.col("larger") + F.row_number().over(Window.partitionBy("size").orderBy("component")) - 1)
    named = rest.select("component", "size", "label").union(_ranked_singles(first))
    return all_nodes.join(named, "component").select("id", "component", "size", F.col("label").cast("int").alias("label"))


def _ranked_singles(singles: DataFrame, parts: int = 4096) -> DataFrame:
    """Labels of the components of one node, most of a sparse cloud: ranked within ranges of ids, so that no task holds them all."""
    ends = singles.agg(F.min("component").alias("lo"), F.max("component").alias("hi")).first()
    wide = max(1.0, ((ends["hi"] or 0) - (ends["lo"] or 0) + 1) / parts)
    placed = singles.withColumn("part", F.floor((F.col("component") - F.lit(ends["lo"] or 0)) / wide))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    counts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("component"))
    return placed.join(F.broadcast(counts), "part").select("component", "size", (F.col("larger") + F.col("before") + rank - 1).alias("label"))  # ``parts`` rows


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, degree, is_leaf)``."""
    ends = edges.select(F.col("u").alias("id")).union(edges.select("v"))
    found = ends.groupBy("id").agg(F.count("*").alias("degree"))
    out = nodes.select("id").join(found, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.withColumn("is_leaf", F.col("degree") == 1)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of ``(u, v, w)``, by Boruvka rounds: each component takes its lightest edge (ties by ends), then components merge.

    Every round at least halves the components that have edges, and works on joins and aggregations alone. As ties are broken, the chosen edges
    lead from each component to a root, the smaller of two that chose the same edge; pointers jump there, twice as far each time.
    """
    chosen, _ = _merged(edges)
    return edges.select("u", "v", "w").limit(0) if chosen is None else chosen.distinct()


def spanning_forest_of_components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest, and ``(id, component)`` of the nodes that have edges, which the rounds of merging give along the way; a component is named by one of its nodes."""
    chosen, groups = _merged(edges)
    if chosen is None:
        return edges.select("u", "v", "w").limit(0), edges.select(F.col("u").alias("id"), F.col("v").alias("component")).limit(0)
    named = groups[0].select(F.col("node").alias("id"), "component")
    for merged in groups[1:]:
        after = merged.select(F.col("node").alias("component"), F.col("component").alias("after"))
        named = named.join(after, "component", "left").select("id", F.coalesce("after", "component").alias("component"))
    return stored(chosen.distinct(), "forest"), stored(named, "components")


def _merged(edges: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """The edges chosen in all rounds, and each round's ``(node, component)``: what the components of the round before became."""
    work = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w")), "edges")
    first, work = work, work.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv"))
    chosen, rounds = None, []
    while not work.isEmpty():
        edge = F.struct("w", "u", "v", "cu", "cv")
        ends = work.select(F.col("cu").alias("c"), edge.alias("e")).union(work.select(F.col("cv"), edge))
        best = stored(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"), "best")
        picked = best.select("u", "v", "w")
        chosen = picked if chosen is None else chosen.union(picked)
        groups = _roots(best)
        rounds.append(groups)
        moved = work
        for end in ("cu", "cv"):
            moved = moved.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"n{end}")), end)
        # of the edges between two components only the lightest can be chosen
        between = F.min(F.struct("w", "u", "v", F.col("ncu").alias("cu"), F.col("ncv").alias("cv"))).alias("e")
        lightest = moved.where("ncu <> ncv").groupBy(F.least("ncu", "ncv").alias("one"), F.greatest("ncu", "ncv").alias("two")).agg(between)
        after = stored(lightest.select("e.u", "e.v", "e.w", "e.cu", "e.cv"), "edges")
        discard(first)
        work, first = after, after
    return chosen, rounds


def _roots(best: DataFrame) -> DataFrame:
    """``(node, component)``: where each component ``c`` comes to by its chosen edge ``(cu, cv)`` in up to eight steps or more, the root of its tree if that is no farther.

    Most components of a sparse graph are one of two that chose the same edge, or beside such a pair, and have their root at once: pointers are only followed for the rest.
    Trees that are deeper come out in parts; the edges between the parts are chosen once more in the next round, so nothing has to be asked before it begins.
    """
    over = best.select("c", F.when(F.col("cu") == F.col("c"), F.col("cv")).otherwise(F.col("cu")).alias("to"))
    back = over.select(F.col("c").alias("to"), F.col("to").alias("back"))
    met = stored(over.join(back, "to").select("c", "to", (F.col("back") == F.col("c")).alias("paired")), "pointers")
    pairs = met.where("paired").select("c", F.least("c", "to").alias("root"))
    beside = stored(met.where("not paired").join(pairs.select(F.col("c").alias("to"), "root"), "to", "left").select("c", "to", "root"), "beside")
    near, now = beside.where("root is not null").select("c", "root"), beside.where("root is null").select("c", "to")
    for _ in range(3):
        step = now.select(F.col("c").alias("to"), F.col("to").alias("next"))
        now = now.join(step, "to", "left").select("c", F.coalesce("next", "to").alias("to"))
    deep = now.join(near.select(F.col("c").alias("to"), "root"), "to", "left").select("c", F.coalesce("root", "to").alias("root"))
    groups = stored(pairs.union(near).union(deep).select(F.col("c").alias("node"), F.col("root").alias("component")), "groups")
    discard(met, beside)
    return groups


def keep_largest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the component with the most nodes (ties: the smallest node)."""
    top = labelled_components(nodes, edges).where("label = 0").select(F.col("id").alias("u"))
    return edges.join(top, "u", "left_semi")


def delete_component(nodes: DataFrame, edges: DataFrame, node: int) -> DataFrame:
    """Edges without the component that holds a node."""
    found = labelled_components(nodes, edges)
    bad = found.join(found.where(F.col("id") == node).select("component"), "component", "left_semi").select(F.col("id").alias("u"))
    return edges.join(bad, "u", "left_anti")


def prune_small(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Edges of components with ``least`` nodes or more."""
    kept = labelled_components(nodes, edges, least).select(F.col("id").alias("u"))
    return edges.join(kept, "u", "left_semi")


def straight_connection(a: tuple[int, float, float, float], b: tuple[int, float, float, float], step: float, first_id: int, spark) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Points every ``step`` on the line between two nodes, numbered from ``first_id``, and the edges that chain them."""
    length = float(np.linalg.norm(np.subtract(a[1:], b[1:])))
    inner = max(0, int(round(length / step)) - 1)
    t = (F.col("k") + 1) / (inner + 1)
    rows = spark.range(inner).select(F.col("id").alias("k"))
    points = rows.select((F.col("k") + first_id).alias("id"), *((F.lit(a[i + 1]) + t * (b[i + 1] - a[i + 1])).alias(f"p{i}") for i in range(3)))
    last = F.when(F.col("k") == inner, F.lit(b[0])).otherwise(F.col("k") + first_id)
    chain = spark.range(inner + 1).select(F.col("id").alias("k")).select(F.when(F.col("k") == 0, F.lit(a[0])).otherwise(F.col("k") + first_id - 1).alias("u"), last.alias("v"), F.lit(length / (inner + 1)).alias("w"))
    return points, chain
