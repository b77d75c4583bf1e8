"""Joining curves at their ends by smooth bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES
from curvespark.operators.curves import bezier_bridge, trim_ends


def _unit(of: dict[int, Column]) -> dict[int, Column]:
    size = F.sqrt(of[0] * of[0] + of[1] * of[1] + of[2] * of[2])
    return {k: F.when(size > 1e-12, of[k] / size).otherwise(F.lit(0.0)) for k in AXES}


def _towards(curves: DataFrame, joins: DataFrame, side: str) -> DataFrame:
    """The curves of one side of each join, numbered so that the joint is at 0, with their outward direction at the joint."""
    rows = curves.join(joins.select(F.col(side).alias("sid"), F.col(f"{side}_end").alias("end"), "new_sid"), "sid")
    last = F.max("k").over(Window.partitionBy("sid"))
    return rows.withColumn("from", F.when(F.col("end") == 1, last - F.col("k")).otherwise(F.col("k")))


def _ends(rows: DataFrame, point: str, way: str) -> DataFrame:
    at = {f"{n}{k}": F.max(F.when(F.col("from") == i, F.col(f"p{k}"))) for k in AXES for i, n in ((0, "e"), (1, "i"))}
    found = rows.groupBy("new_sid").agg(*(c.alias(n) for n, c in at.items()))
    out = _unit({k: F.coalesce(F.col(f"e{k}") - F.col(f"i{k}"), F.lit(0.0)) for k in AXES})
    return found.select("new_sid", *(F.col(f"e{k}").alias(f"{point}{k}") for k in AXES), *(out[k].alias(f"{way}{k}") for k in AXES))


def join_ends(curves: DataFrame, joins: DataFrame, points: int = 16, back: float = 0.0) -> DataFrame:
    """Curves with those of each join (a, a_end, b, b_end, new_sid; end 0 is the start and 1 the end) made one: a up to the joint, a cubic bridge, b from the joint on.

    ``back`` trims both curves' ends first, so that the bridge has room. A curve takes part in one join at most; others stay as they are.
    """
    if back > 0:
        used = joins.select(F.col("a").alias("sid")).union(joins.select("b"))
        curves = trim_ends(curves.join(used, "sid", "left_semi"), back).unionByName(curves.join(used, "sid", "left_anti"))
    a, b = _towards(curves, joins, "a"), _towards(curves, joins, "b")
    ends = _ends(a, "a", "s").join(_ends(b, "b", "t"), "new_sid").withColumnRenamed("new_sid", "sid")
    bridge = bezier_bridge(ends, points).where((F.col("k") > 0) & (F.col("k") < points - 1))
    xyz = [f"p{k}" for k in AXES]
    parts = a.select(F.col("new_sid").alias("sid"), F.lit(0).alias("part"), (-F.col("from")).alias("at"), *xyz)
    parts = parts.union(bridge.select("sid", F.lit(1), F.col("k").cast("long"), *xyz)).union(b.select("new_sid", F.lit(2), "from", *xyz))
    made = parts.withColumn("k", F.row_number().over(Window.partitionBy("sid").orderBy("part", "at")) - 1)
    gone = joins.select(F.col("a").alias("sid")).union(joins.select("b"))
    rest = curves.join(gone, "sid", "left_anti")
    return rest.select("sid", "k", *xyz).union(made.select("sid", F.col("k").cast("long"), *xyz))


def close_loops(curves: DataFrame, sids: DataFrame, points: int = 16) -> DataFrame:
    """Curves with those named in ``sids`` closed by a bridge from their end to their start."""
    rows = curves.join(sids.select("sid"), "sid", "left_semi").withColumn("last", F.max("k").over(Window.partitionBy("sid")))
    tail = _ends(rows.withColumn("from", F.col("last") - F.col("k")).withColumn("new_sid", F.col("sid")), "a", "s")
    head = _ends(rows.withColumn("from", F.col("k")).withColumn("new_sid", F.col("sid")), "b", "t")
    bridge = bezier_bridge(tail.join(head, "new_sid").withColumnRenamed("new_sid", "sid"), points).where((F.col("k") > 0) & (F.col("k") < points))
    first = rows.groupBy("sid").agg(F.max("k").alias("last"))
    xyz = [f"p{k}" for k in AXES]
    return curves.select("sid", "k", *xyz).union(bridge.join(first, "sid").select("sid", (F.col("last") + F.col("k")).cast("long"), *xyz))
