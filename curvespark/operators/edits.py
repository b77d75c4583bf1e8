"""Edit logs: replaying versions, undo, and work sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDO_DEPTH = 10
IDLE_MINUTES = 30


def replay(log: DataFrame, version: str = "version", key: str = "id") -> DataFrame:
    """The state after all edits: each key's last value, without keys whose last edit deletes them (``kind`` 'delete')."""
    others = [c for c in log.columns if c not in (key, version)]
    last = log.groupBy(key).agg(F.max_by(F.struct(version, *others), version).alias("r"))
    return last.select(key, F.col(f"r.{version}").alias(version), *(F.col(f"r.{c}").alias(c) for c in others)).where("kind <> 'delete'")


def undo_stack(log: DataFrame, depth: int = UNDO_DEPTH, group: str = "sid", order: tuple[str, ...] = ("ts", "g1")) -> DataFrame:
    """The newest ``depth`` edits of each session, numbered from the newest."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*(F.desc(c) for c in order)))
    return log.withColumn("depth", rank).where(F.col("depth") <= depth)


def sessions(log: DataFrame, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """``(sid, session, start, end, edits, connects, synthetic, active_s)``: runs of edits without a longer pause."""
    by = Window.partitionBy("sid").orderBy("ts", "g1")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(by)) / 1e6
    rows = log.withColumn("gap", gap).withColumn("starts", F.when(F.col("gap").isNull() | (F.col("gap") > idle_minutes * 60), 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    active = F.sum(F.when(F.col("starts") == 0, F.col("gap")).otherwise(0.0))
    return rows.groupBy("sid", "session").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("edits"), F.sum(F.when(F.col("kind") == "B", 1).otherwise(0)).alias("connects"), F.sum("n_synth").alias("synthetic"), active.alias("active_s")
    )


def new_junctions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes of degree three or more in the edges ``after`` that weren't such in ``before``."""

    def hubs(edges: DataFrame) -> DataFrame:
        ends = edges.select(F.col("u").alias("id")).union(edges.select("v"))
        return ends.groupBy("id").count().where("count >= 3").select("id")

    return hubs(after).join(hubs(before), "id", "left_anti")


def break_boxes(breaks: DataFrame, margin: float = 12.0) -> DataFrame:
    """Boxes about each region's points, widened by a margin."""
    ends = [f(f"p{k}").alias(f"{n}{k}") for k in range(3) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    box = breaks.groupBy("region").agg(*ends)
    return box.select("region", *((F.col(f"lo{k}") - margin).alias(f"lo{k}") for k in range(3)), *((F.col(f"hi{k}") + margin).alias(f"hi{k}") for k in range(3)))
