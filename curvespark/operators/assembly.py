"""From an oriented cloud to smooth curves, by the operators of the other modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvespark.operators import curves as V
from curvespark.operators import fitting, graph, trees
from curvespark.operators.cloud import AXES
from curvespark.plans.lineage import stored


def component_curves(cloud: DataFrame, tree: DataFrame, least_points: int = 30, smooth: float = 1.5, spacing: float = 1.0, turn: float = 180.0, least_length: float = 20.0, near: float = 6.0, share: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Smooth curves ``(sid, k, p*)`` along the trees ``(u, v, w)`` of a cloud, and ``(sid, component)``.

    Components of under ``least_points`` nodes are left out, and nodes without edges. If one is left, its longest path is the one curve; else longest paths are peeled
    off while they have a third of ``least_points`` nodes (four at least). Paths are cut at turns of over ``turn`` degrees and fitted by smoothing splines; pieces of under four points,
    curves shorter than ``least_length`` and those that run within ``near`` of longer ones for ``share`` of their points go. Curves are numbered by component, path and piece.
    """
    nodes = tree.select(F.col("u").alias("id")).union(tree.select("v")).distinct()
    parts = stored(graph.labelled_components(nodes, tree, least_points), "components")
    own = stored(graph.prune_small(nodes, tree, least_points), "tree")
    if parts.select("component").distinct().count() == 1:
        paths = trees.longest_paths(own, parts).select("component", F.lit(0).cast("long").alias("path"), "k", "id")
    else:
        paths = trees.peeled_paths(own, parts, 0.0, max(4, least_points // 3))
    placed = paths.join(cloud.select("id", *(f"p{k}" for k in AXES)), "id")
    ordered = placed.select(F.struct("component", "path").alias("sid"), "k", *(f"p{k}" for k in AXES))
    pieces = V.split_at_turns(ordered, turn)
    by = Window.partitionBy("sid", "piece")
    pieces = pieces.withColumn("n", F.count("*").over(by)).where("n >= 4").withColumn("at", F.row_number().over(by.orderBy("k")) - 1)
    pieces = stored(pieces.select(F.col("sid.component").alias("component"), F.col("sid.path").alias("path"), "piece", F.col("at").alias("k"), *(f"p{k}" for k in AXES)), "pieces")
    names = stored(numbered_curves(pieces), "names")
    keyed = pieces.join(names, ["component", "path", "piece"]).select("sid", "k", *(f"p{k}" for k in AXES))
    fitted = stored(fitting.fit_curves(keyed, smooth, spacing), "fitted")
    long = V.total_length(fitted).where(F.col("length") >= least_length).select("sid")
    kept = fitting.without_repeats(fitted.join(long, "sid", "left_semi"), near, share)
    return kept, names.join(kept.select("sid").distinct(), "sid", "left_semi").select("sid", "component")


def numbered_curves(pieces: DataFrame) -> DataFrame:
    """``(component, path, piece, sid)``: curves numbered through by component, path and piece; components are counted first, so that no task orders all curves."""
    each = pieces.select("component", "path", "piece").distinct()
    sizes = each.groupBy("component").agg(F.count("*").alias("n"))
    parts = sizes.withColumn("part", F.floor(F.col("component") / 65_536))
    of_part = parts.groupBy("part").agg(F.sum("n").alias("m"))
    before_part = of_part.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))  # a row a part
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.join(before_part, "part").select("component", (F.col("p") + own).alias("before"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy("path", "piece")) - 1
    return each.withColumn("rank", rank).join(before, "component").select("component", "path", "piece", (F.col("before") + F.col("rank")).alias("sid"))


def endpoint_loops(joins: DataFrame) -> DataFrame:
    """``(combo, loops)``: whether the joins of each combination close a loop; ``joins`` are ``(combo, a, a_end, b, b_end)`` of curves and their ends (0, 1).

    Curves and joins are the edges of a graph of ends, in which every end has one of each at most: a connected piece is a loop if it has as many edges as ends.
    """
    end = lambda s, e: F.struct("combo", F.col(s).alias("curve"), e.alias("end"))
    used = joins.select("combo", F.col("a").alias("curve")).union(joins.select("combo", "b")).distinct()
    own = used.select(end("curve", F.lit(0)).alias("u"), end("curve", F.lit(1)).alias("v"))
    edges = stored(own.union(joins.select(end("a", F.col("a_end").cast("int")), end("b", F.col("b_end").cast("int")))), "edges")
    # ends as numbers, so that components have a smallest one
    ids = stored(edges.select(F.col("u").alias("end")).union(edges.select("v")).distinct().withColumn("id", F.monotonically_increasing_id()), "ends")
    plain = edges.join(ids.withColumnsRenamed({"end": "u", "id": "i"}), "u").join(ids.withColumnsRenamed({"end": "v", "id": "j"}), "v").select("i", "j", F.col("u.combo").alias("combo"))
    plain = stored(plain, "plain")
    named = graph.connected_components(plain, "i", "j").withColumnsRenamed({"node": "i"})
    ends = named.groupBy("component").agg(F.count("*").alias("ends"))
    counted = plain.join(named, "i").groupBy("combo", "component").agg(F.count("*").alias("edges")).join(ends, "component")
    # a join of a curve's end with itself is an edge of the graph without a component of its own
    found = counted.groupBy("combo").agg(F.max(F.col("edges") >= F.col("ends")).alias("loops"))
    return joins.select("combo").distinct().join(found, "combo", "left").select("combo", F.coalesce("loops", F.lit(True)).alias("loops"))


def run_stages(spark: SparkSession, source: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], path: str) -> DataFrame:
    """The result of named stages, one after the other, each written as Parquet below ``path``; a stage whose result is complete there is read and not run again."""
    now = source
    for name, stage in stages:
        at = f"{path.rstrip('/')}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            stage(now).write.mode("overwrite").parquet(at)
        now = spark.read.parquet(at)
    return now
