"""Work sessions as tables: adjacency packed row by row, positions added and overridden, nodes deleted, where arms were broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES
from curvespark.operators.junctions import arcs, overridden
from curvespark.operators.records import load_version, save_version
from curvespark.plans.lineage import ordered

PARTS = ("keys", "neighbours", "extras", "overrides", "deleted", "breaks")


def packed_adjacency(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(place, key, start, stop)`` and ``(position, node)``: the nodes that have edges, ascending, and all their neighbours in one sequence, ascending in each node's stretch from ``start`` to ``stop``."""
    both = arcs(tree).distinct()
    sequence = ordered(both, ["a", "b"], "position", "neighbours")
    stretches = sequence.groupBy(F.col("a").alias("key")).agg(F.min("position").alias("start"), (F.max("position") + 1).alias("stop"))
    return ordered(stretches, ["key"], "place", "keys").select("place", "key", "start", "stop"), sequence.select("position", F.col("b").alias("node"))


def unpacked_adjacency(keys: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``(u, v)`` with ``u < v``: the edges of a packed adjacency. A place in no stretch, and edges that only one of their ends names, are edges all the same."""
    named = keys.where("stop > start").select("key", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("position"))
    rows = named.join(neighbours, "position").where("key <> node")
    return rows.select(F.least("key", "node").alias("u"), F.greatest("key", "node").alias("v")).distinct()


def save_state(path: str, tag: str, at: str, tree: DataFrame, extras: DataFrame | None = None, overrides: DataFrame | None = None, deleted: DataFrame | None = None, breaks: DataFrame | None = None) -> None:
    """Write a session below ``path`` as a version of its own: the forest ``(u, v)`` packed, points added ``(id, p*)``, overrides ``(id, p*)``, deleted nodes ``(id)``, breaks ``(region, side, p*)``; parts that are None are written empty."""
    spark = tree.sparkSession
    none = {"extras": "id long, p0 double, p1 double, p2 double", "overrides": "id long, p0 double, p1 double, p2 double", "deleted": "id long", "breaks": "region long, side int, p0 double, p1 double, p2 double"}
    keys, neighbours = packed_adjacency(tree)
    given = {"keys": keys, "neighbours": neighbours, "extras": extras, "overrides": overrides, "deleted": deleted, "breaks": breaks}
    save_version({k: v if v is not None else spark.createDataFrame([], none[k]) for k, v in given.items()}, path, tag, at)


def load_state(spark: SparkSession, path: str, tags: list[str]) -> dict[str, DataFrame] | None:
    """The newest session of the first of ``tags`` that has one: its ``tree`` ``(u, v)`` and the other parts; None if there is none."""
    found = {part: load_version(spark, path, part, tags) for part in PARTS}
    if found["keys"] is None:
        return None
    return {"tree": unpacked_adjacency(found.pop("keys"), found.pop("neighbours"))} | found


def resumed(cloud: DataFrame, state: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The cloud and the forest ``(u, v, w)`` as the session left them: points added, positions overridden, deleted nodes gone with their edges; ``w`` is the length between the positions."""
    xyz = [f"p{k}" for k in AXES]
    points = overridden(cloud.select("id", *xyz).unionByName(state["extras"].select("id", *xyz)), state["overrides"], state["deleted"])
    a, b = (points.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}{c}") for c in xyz)) for end in "uv")
    rows = state["tree"].join(a, "u").join(b, "v")
    w = F.sqrt(sum(((F.col(f"u{c}") - F.col(f"v{c}")) * (F.col(f"u{c}") - F.col(f"v{c}")) for c in xyz), F.lit(0.0)))
    return points, rows.select("u", "v", w.alias("w"))


def saved_points(cloud: DataFrame, now: DataFrame) -> DataFrame:
    """The points ``now`` ``(id, p*)`` with the other columns of the cloud that they come from, or without them if points came or went."""
    other = [c for c in cloud.columns if c not in ("id", *(f"p{k}" for k in AXES))]
    counts = cloud.select("id").exceptAll(now.select("id")).limit(1).count() + now.select("id").exceptAll(cloud.select("id")).limit(1).count()
    return now if counts else now.join(cloud.select("id", *other), "id")
