"""Elastic rods: rest shape, energies and forces as window and aggregate expressions; the implicit integrator as one task a sample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES

def _order():  # noqa: ANN202
    return Window.partitionBy("sid").orderBy("k")


@dataclass(frozen=True)
class RodParameters:
    """Stiffnesses, gravity, contact and time steps."""

    stretch: float = 4e5
    bend: float = 3e2
    contact: float = 8e4
    gravity: float = -1500.0
    radius: float = 20.0
    damping: float = 0.012
    dt: float = 1 / 60
    substeps: int = 4


def _binormal(rows: DataFrame) -> tuple[list[Column], Column]:
    """The curvature binormal at each inner point from edges ``e*`` before and ``g*`` after it, and the half-lengths about it."""
    e, g = [F.col(f"e{k}") for k in AXES], [F.col(f"g{k}") for k in AXES]
    cross = [e[1] * g[2] - e[2] * g[1], e[2] * g[0] - e[0] * g[2], e[0] * g[1] - e[1] * g[0]]
    le, lg = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2]), F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
    scale = 2 / (le * lg + e[0] * g[0] + e[1] * g[1] + e[2] * g[2] + 1e-12)
    return [scale * c for c in cross], (le + lg) / 2


def rest_curvature(curves: DataFrame) -> DataFrame:
    """``(sid, k, kb0..kb2, vor)`` at inner points."""
    rows = curves.withColumns({f"e{k}": F.col(f"p{k}") - F.lag(f"p{k}").over(_order()) for k in AXES} | {f"g{k}": F.lead(f"p{k}").over(_order()) - F.col(f"p{k}") for k in AXES})
    kb, vor = _binormal(rows)
    return rows.where("e0 is not null and g0 is not null").select("sid", "k", *(kb[k].alias(f"kb{k}") for k in AXES), vor.alias("vor"))


def bending_energy(curves: DataFrame, rest: DataFrame, stiffness: float) -> DataFrame:
    """``(sid, energy)`` of curves against a rest shape."""
    now = rest_curvature(curves).select("sid", "k", *(F.col(f"kb{k}").alias(f"now{k}") for k in AXES))
    gap = [F.col(f"now{k}") - F.col(f"kb{k}") for k in AXES]
    each = 0.5 * stiffness * (gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) / F.greatest(F.col("vor"), F.lit(1e-9))
    return now.join(rest, ["sid", "k"]).groupBy("sid").agg(F.sum(each).alias("energy"))


def stretch_and_ground_forces(curves: DataFrame, rest_length: float, ground: float, mass: float, p: RodParameters = RodParameters()) -> DataFrame:
    """``(sid, k, f0..f2)``: gravity, edges pulled to their rest length, and the ground's push; axis 2 points up."""
    edge = [F.lead(f"p{k}").over(_order()) - F.col(f"p{k}") for k in AXES]
    rows = curves.withColumns({f"e{k}": edge[k] for k in AXES})
    length = F.sqrt(F.col("e0") * F.col("e0") + F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2")) + 1e-12
    rows = rows.withColumn("len", length)
    rows = rows.withColumns({f"a{k}": F.coalesce(p.stretch * (F.col("len") - rest_length) / rest_length * F.col(f"e{k}") / F.col("len"), F.lit(0.0)) for k in AXES})
    total = [F.col(f"a{k}") - F.coalesce(F.lag(f"a{k}").over(_order()), F.lit(0.0)) for k in AXES]
    sunk = F.greatest(F.lit(ground + p.radius) - F.col("p2"), F.lit(0.0))
    total[2] = total[2] + mass * p.gravity + p.contact * sunk
    return rows.select("sid", "k", *(total[k].alias(f"f{k}") for k in AXES))


def _bend_energy(x: np.ndarray, kb0: np.ndarray, vor: np.ndarray, stiffness: float) -> np.ndarray:
    e, g = x[1:-1] - x[:-2], x[2:] - x[1:-1]
    scale = 2 / (np.linalg.norm(e, axis=1) * np.linalg.norm(g, axis=1) + (e * g).sum(1) + 1e-12)
    gap = np.cross(e, g) * scale[:, None] - kb0
    return 0.5 * stiffness * (gap**2).sum(1) / np.maximum(vor, 1e-9)


def _forces(x: np.ndarray, rest: np.ndarray, kb0: np.ndarray, vor: np.ndarray, ground: float, mass: np.ndarray, p: RodParameters, h: float = 1e-4) -> np.ndarray:
    f = np.zeros_like(x)
    f[:, 2] += mass * p.gravity + p.contact * np.maximum(ground + p.radius - x[:, 2], 0)
    e = np.diff(x, axis=0)
    length = np.linalg.norm(e, axis=1) + 1e-12
    pull = (p.stretch * (length - rest) / rest / length)[:, None] * e
    f[:-1] += pull
    f[1:] -= pull
    if len(x) > 2:
        for axis in AXES:
            for colour in range(3):  # every third point moves at once: triples overlap in no moved point twice
                moved = np.zeros(len(x))
                moved[colour::3] = h
                shift = np.zeros_like(x)
                shift[:, axis] = moved
                change = (_bend_energy(x + shift, kb0, vor, p.bend) - _bend_energy(x - shift, kb0, vor, p.bend)) / (2 * h)
                owner = np.arange(len(change)) + (colour - np.arange(len(change))) % 3
                np.add.at(f[:, axis], owner, -change)
    return f


def simulate(samples: DataFrame, frames: int, ground: float | None = None, mass: float = 1.0, p: RodParameters = RodParameters()) -> DataFrame:
    """``(sid, frame, k, p0..p2, penetration)``: each rod falls under implicit Euler steps, solved by conjugate gradients; a rod is what one task holds."""

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        x = rows[["p0", "p1", "p2"]].to_numpy(float)
        rest, m = np.linalg.norm(np.diff(x, axis=0), axis=1), np.full(len(x), mass)
        e, g = x[1:-1] - x[:-2], x[2:] - x[1:-1]
        scale = 2 / (np.linalg.norm(e, axis=1) * np.linalg.norm(g, axis=1) + (e * g).sum(1) + 1e-12)
        kb0, vor = np.cross(e, g) * scale[:, None], (np.linalg.norm(e, axis=1) + np.linalg.norm(g, axis=1)) / 2
        floor = x[:, 2].min() - p.radius if ground is None else ground
        force: Callable[[np.ndarray], np.ndarray] = lambda y: _forces(y, rest, kb0, vor, floor, m, p)
        v, h, out = np.zeros_like(x), p.dt / p.substeps, []
        for frame in range(frames + 1):
            sunk = float(np.maximum(floor + p.radius - x[:, 2], 0).max())
            out.append(pd.DataFrame({"sid": key[0], "frame": frame, "k": rows["k"].to_numpy(), "p0": x[:, 0], "p1": x[:, 1], "p2": x[:, 2], "penetration": sunk}))
            for _ in range(p.substeps if frame < frames else 0):
                f0 = force(x)
                apply = lambda d: m[:, None] * d - h * h * (force(x + 1e-5 * d) - f0) / 1e-5  # noqa: B023, E731
                b = h * (f0 + h * (force(x + 1e-5 * v) - f0) / 1e-5)
                dv, r = np.zeros_like(x), b.copy()
                q, rr = r.copy(), float((r * r).sum())
                stop = 1e-6 * rr
                for _ in range(60):
                    if rr <= stop or rr == 0:
                        break
                    aq = apply(q)
                    step = rr / float((q * aq).sum())
                    dv, r = dv + step * q, r - step * aq
                    new = float((r * r).sum())
                    q, rr = r + new / rr * q, new
                v = (v + dv) * (1 - p.damping)
                x = x + h * v
        return pd.concat(out)

    kind = samples.schema["sid"].dataType.simpleString()
    return samples.select("sid", "k", "p0", "p1", "p2").groupBy("sid").applyInPandas(rule, f"sid {kind}, frame long, k long, p0 double, p1 double, p2 double, penetration double")
