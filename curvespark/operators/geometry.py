"""Procedural geometry: directions, frames, plies, fibres and tubes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES
from curvespark.operators.records import fixed
from curvespark.operators.curves import arc_length

GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))


def hemisphere_directions(spark: SparkSession, n: int = 128) -> DataFrame:
    """Evenly spread directions on the upper half of the sphere, by the golden ratio."""
    z = (F.col("id") + 0.5) / n
    r, angle = F.sqrt(1 - z * z), 2 * F.pi() * F.col("id") / ((1 + math.sqrt(5)) / 2)
    return spark.range(n).select("id", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"), z.alias("z"))


def nearest_direction(cloud: DataFrame, n: int = 128) -> DataFrame:
    """``(id, direction, lean)``: of ``n`` directions of the hemisphere the one that each point's direction leans to most, either way round (ties: the first); points without a direction are left out."""
    bank = hemisphere_directions(cloud.sparkSession, n).withColumnRenamed("id", "direction")
    lean = F.abs(F.col("d0") * F.col("x") + F.col("d1") * F.col("y") + F.col("d2") * F.col("z"))
    rows = cloud.where("d0 * d0 + d1 * d1 + d2 * d2 > 1e-16").select("id", "d0", "d1", "d2").join(F.broadcast(bank), F.lit(True))  # ``n`` rows
    best = F.max(F.struct(F.round(lean, 9).alias("lean"), (-F.col("direction")).alias("m"))).alias("b")
    return rows.groupBy("id").agg(best).select("id", (-F.col("b.m")).alias("direction"), F.col("b.lean").alias("lean"))


def frames(curves: DataFrame) -> DataFrame:
    """Rotation-minimising frames: ``t*`` tangent, ``n*`` and ``b*`` across it, carried from point to point by double reflection.

    The recurrence runs along a curve, so a curve is what one task holds.
    """

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        p = rows[["p0", "p1", "p2"]].to_numpy(float)
        step = np.gradient(p, axis=0) if len(p) > 1 else np.array([[1.0, 0, 0]] * len(p))
        t = step / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12)
        n = np.zeros_like(t)
        axis = np.eye(3)[np.argmin(np.abs(t[0]))]
        n[0] = np.cross(t[0], axis)
        n[0] /= max(np.linalg.norm(n[0]), 1e-12)
        for k in range(len(p) - 1):
            v = p[k + 1] - p[k]
            c = v @ v
            if c < 1e-24:
                n[k + 1] = n[k]
                continue
            nl, tl = n[k] - 2 * (v @ n[k]) / c * v, t[k] - 2 * (v @ t[k]) / c * v
            w = t[k + 1] - tl
            c2 = w @ w
            n[k + 1] = nl if c2 < 1e-24 else nl - 2 * (w @ nl) / c2 * w
        b = np.cross(t, n)
        return pd.DataFrame({"sid": key[0], "k": rows["k"].to_numpy()} | {f"{s}{i}": m[:, i] for s, m in (("t", t), ("n", n), ("b", b)) for i in AXES})

    kind = curves.schema["sid"].dataType.simpleString()
    fields = ", ".join(f"{s}{i} double" for s in "tnb" for i in AXES)
    return curves.select("sid", "k", "p0", "p1", "p2").groupBy("sid").applyInPandas(rule, f"sid {kind}, k long, {fields}")


def plies(framed: DataFrame, n: int, pitch: float, radius: float, sign: float = 1.0) -> DataFrame:
    """``(sid, ply, k, p*)``: ``n`` helices about each curve, whose rows hold position, arc length ``s`` and the frame's ``n*`` and ``b*``."""
    rows = framed.withColumn("ply", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = sign * 2 * F.pi() * F.col("s") / pitch + 2 * F.pi() * F.col("ply") / n
    return rows.select("sid", "ply", "k", *((F.col(f"p{i}") + radius * (F.cos(angle) * F.col(f"n{i}") + F.sin(angle) * F.col(f"b{i}"))).alias(f"p{i}") for i in AXES))


def fibres(framed: DataFrame, n: int, pitch: float, bundle: float, migration: float = 0.0, sign: float = 1.0) -> DataFrame:
    """``(sid, fibre, k, p*)``: fibres fill a disc by the golden angle and twist about the curve; ``migration`` lets their radius swing."""
    rows = framed.withColumn("fibre", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    phase = F.col("fibre") * GOLDEN_ANGLE
    angle = sign * 2 * F.pi() * F.col("s") / pitch + phase
    r = bundle * F.sqrt((F.col("fibre") + 0.5) / n) * (1 - migration + migration * 0.5 * (F.cos(angle + phase) + 1))
    return rows.select("sid", "fibre", "k", *((F.col(f"p{i}") + r * (F.cos(angle) * F.col(f"n{i}") + F.sin(angle) * F.col(f"b{i}"))).alias(f"p{i}") for i in AXES))


def framed(curves: DataFrame) -> DataFrame:
    """Curves with arc length and frame."""
    return arc_length(curves).join(frames(curves), ["sid", "k"])


def tube_vertices(with_frames: DataFrame, sides: int, radius: float) -> DataFrame:
    """``(sid, vertex, x, y, z)``: a ring of ``sides`` about each point."""
    rows = with_frames.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    angle = 2 * F.pi() * F.col("j") / sides
    return rows.select("sid", (F.col("k") * sides + F.col("j")).alias("vertex"), *((F.col(f"p{i}") + radius * (F.cos(angle) * F.col(f"n{i}") + F.sin(angle) * F.col(f"b{i}"))).alias("xyz"[i]) for i in AXES))


def tube_faces(curves: DataFrame, sides: int) -> DataFrame:
    """``(sid, face, a, b, c)``: two triangles for each side between rings."""
    n = curves.groupBy("sid").agg(F.count("*").alias("n")).where("n > 1")
    quads = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    a, b = F.col("i") * sides + F.col("j"), F.col("i") * sides + (F.col("j") + 1) % sides
    two = F.array(F.struct((2 * a).alias("face"), a.alias("a"), b.alias("b"), (a + sides).alias("c")), F.struct((2 * a + 1).alias("face"), b.alias("a"), (b + sides).alias("b"), (a + sides).alias("c")))
    return quads.select("sid", F.explode(two).alias("f")).select("sid", "f.face", "f.a", "f.b", "f.c")


def obj_lines(curves: DataFrame) -> DataFrame:
    """``(sid, place, line)``: curves as OBJ text, vertices and then one polyline for each curve, numbered within the curve."""
    vertex = F.concat_ws(" ", F.lit("v"), *(fixed(F.col(f"p{k}"), 6) for k in AXES))
    points = curves.select("sid", F.col("k").alias("place"), vertex.alias("line"))
    lines = curves.groupBy("sid").agg(F.count("*").alias("n")).select("sid", F.col("n").alias("place"), F.concat(F.lit("l "), F.array_join(F.sequence(F.lit(1).cast("long"), F.col("n")), " ")).alias("line"))
    return points.union(lines)


def hierarchy(curves: DataFrame, n_plies: int, pitch: float, radius: float, n_fibres: int = 0, fibre_pitch: float = 1.0, bundle: float = 0.0, migration: float = 0.0, sign: float = 1.0, shake: float = 0.0, grain: float = 0.0) -> tuple[DataFrame, DataFrame | None]:
    """Plies ``(sid, ply, k, p*)`` about each curve and fibres ``(sid, ply, fibre, k, p*)`` about each ply (None for no fibres): frames are carried along the curve, and then along every ply.

    With ``shake`` plies are moved by noise of that size and ``grain``, which their fibres follow, and fibres by half of it in a grain four times as fine. Keys nest: a ply is a curve named by
    its curve and number, so each is a group of its own wherever it runs.
    """
    from curvespark.operators.noise import warped

    def shaken(lines: DataFrame, keys: list[str], size: float, fine: float) -> DataFrame:
        if not size:
            return lines
        named = lines.withColumn("sid", F.to_json(F.struct(*keys)))
        moved = warped(named.select("sid", "k", "p0", "p1", "p2"), fine, size)
        return lines.select(*keys, "k", F.to_json(F.struct(*keys)).alias("name")).join(moved.withColumnRenamed("sid", "name"), ["name", "k"]).select(*keys, "k", "p0", "p1", "p2")

    strands = shaken(plies(framed(curves), n_plies, pitch, radius, sign), ["sid", "ply"], shake, grain)
    if not n_fibres:
        return strands, None
    own = strands.withColumn("name", F.to_json(F.struct("sid", "ply")))
    names = own.select("name", "sid", "ply").distinct()
    found = fibres(framed(own.select(F.col("name").alias("sid"), "k", "p0", "p1", "p2")), n_fibres, fibre_pitch, bundle, migration, sign)
    found = found.withColumnRenamed("sid", "name").join(names, "name").select("sid", "ply", "fibre", "k", "p0", "p1", "p2")
    return strands, shaken(found, ["sid", "ply", "fibre"], 0.5 * shake, 4.0 * grain)


def upsampled(curves: DataFrame, factor: int = 3) -> DataFrame:
    """``(sid, k, p*)``: each curve with ``factor`` - 1 points more between any two, on the cubic spline through its points whose third derivative is continuous at the second and the last but one; curves of three points follow a parabola, of two a line.

    The spline's equations run along the curve, so a curve is what one task holds; they are solved as a band.
    """

    def slopes(p: np.ndarray) -> np.ndarray:
        n = len(p)
        if n < 3:
            return np.repeat(np.diff(p, axis=0), n, 0) if n == 2 else np.zeros_like(p)
        d = np.diff(p, axis=0)
        if n == 3:
            bend = d[1] - d[0]
            return np.stack([d[0] - bend / 2, (d[0] + d[1]) / 2, d[1] + bend / 2])
        below, main, above, right = np.ones(n), np.full(n, 4.0), np.ones(n), np.empty_like(p)
        right[1:-1] = 3 * (d[1:] + d[:-1])
        main[0], above[0], right[0] = 1.0, 2.0, (5 * d[0] + d[1]) / 2
        main[-1], below[-1], right[-1] = 1.0, 2.0, (5 * d[-1] + d[-2]) / 2
        for k in range(1, n):
            share = below[k] / main[k - 1]
            main[k] -= share * above[k - 1]
            right[k] -= share * right[k - 1]
        out = np.empty_like(p)
        out[-1] = right[-1] / main[-1]
        for k in range(n - 2, -1, -1):
            out[k] = (right[k] - above[k] * out[k + 1]) / main[k]
        return out

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values("k")[["p0", "p1", "p2"]].to_numpy(float)
        m = slopes(p)
        at = np.arange((len(p) - 1) * factor + 1)
        k = np.minimum(at // factor, max(len(p) - 2, 0))
        u = ((at - k * factor) / factor)[:, None]
        last = np.minimum(k + 1, len(p) - 1)
        q = (2 * u**3 - 3 * u**2 + 1) * p[k] + (u**3 - 2 * u**2 + u) * m[k] + (3 * u**2 - 2 * u**3) * p[last] + (u**3 - u**2) * m[last]
        return pd.DataFrame({"sid": key[0], "k": at} | {f"p{i}": q[:, i] for i in AXES})

    kind = curves.schema["sid"].dataType.simpleString()
    return curves.select("sid", "k", "p0", "p1", "p2").groupBy("sid").applyInPandas(rule, f"sid {kind}, k long, p0 double, p1 double, p2 double")
