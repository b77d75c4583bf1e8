"""Gradient noise and hairs for procedural strands."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CORNERS = np.array(list(itertools.product((0, 1), repeat=3)))
#: The gradients of improved Perlin noise in their order, and where in the noise the three channels of a vector field are read.
GRADIENTS = ((1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1), (0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1))
CHANNELS = (0.0, 19.1, 53.7)


def lattice_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(256)


def lattice_noise(p: np.ndarray, seed: int = 0) -> np.ndarray:
    """Noise in -1..1 at points ``(n, 3)``: zero on the lattice, smooth between (a quintic fade)."""
    table, gradients = lattice_table(seed), np.array(GRADIENTS, float)
    cell = np.floor(p).astype(np.int64)
    part = p - cell
    fade = part**3 * (part * (part * 6 - 15) + 10)
    out = np.zeros(len(p))
    for corner in _CORNERS:
        at = (cell + corner) & 255
        pick = table[(table[(table[at[:, 0]] + at[:, 1]) & 255] + at[:, 2]) & 255] % len(GRADIENTS)
        slope = (gradients[pick] * (part - corner)).sum(1)
        out += slope * np.prod(np.where(corner == 1, fade, 1 - fade), axis=1)
    return out


def warped(curves: DataFrame, scale: float, size: float, seed: int = 0) -> DataFrame:
    """Curves whose points are moved by three channels of noise at ``scale`` times their positions, ``size`` strong; without either they stay."""
    if size <= 1e-9 or scale <= 0:
        return curves

    @F.pandas_udf("p0 double, p1 double, p2 double")
    def move(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        p = np.stack([a, b, c], 1).astype(float)
        by = np.stack([lattice_noise(p * scale + at, seed) for at in CHANNELS], 1)
        return pd.DataFrame(p + size * by, columns=["p0", "p1", "p2"])

    moved: Column = move("p0", "p1", "p2")
    others = [c for c in curves.columns if c not in ("p0", "p1", "p2")]
    return curves.select(*others, moved.alias("m")).select(*others, "m.*")


def hairs(curves: DataFrame, each: float, length: float, points: int = 8, curl: float = 0.5, seed: int = 0) -> DataFrame:
    """``(sid, hair, k, p0..p2)``: hairs that leave a curve at random, about one every ``each`` of its length, and wander as they grow; the same for the same seed and curve."""

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values("k")[["p0", "p1", "p2"]].to_numpy(float)
        total = float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum())
        rng = np.random.default_rng((seed, abs(hash(int(key[0])))))
        n = int(total // each)
        root, way = p[rng.integers(0, len(p), n)], rng.standard_normal((n, 3))
        out = []
        for k in range(points):
            out.append(pd.DataFrame({"sid": key[0], "hair": np.arange(n), "k": k} | {f"p{i}": root[:, i] for i in range(3)}))
            way = way / np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-12)
            root = root + way * length / max(points - 1, 1)
            way = way + curl * rng.standard_normal((n, 3))
        return pd.concat(out) if n else pd.DataFrame({c: [] for c in ("sid", "hair", "k", "p0", "p1", "p2")})

    kind = curves.schema["sid"].dataType.simpleString()
    return curves.select("sid", "k", "p0", "p1", "p2").groupBy("sid").applyInPandas(rule, f"sid {kind}, hair long, k long, p0 double, p1 double, p2 double")
