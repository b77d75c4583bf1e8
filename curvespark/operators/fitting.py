"""Smooth curves through ordered points, and leaving out curves that repeat longer ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespark.operators.cloud import neighbours
from curvespark.operators.curves import total_length
from curvespark.plans.lineage import discard, stored


def _basis(t: np.ndarray, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the four cubic B-splines on clamped knots that aren't zero at each ``t``, and the four values."""
    t = np.clip(t, knots[0], np.nextafter(knots[-1], 0))
    at = np.clip(np.searchsorted(knots, t, "right") - 1, 3, len(knots) - 5)
    b = np.ones((len(t), 1))
    for p in range(1, 4):
        wider = np.zeros((len(t), p + 1))
        for r in range(p):
            low, high = knots[at + r + 1 - p], knots[at + r + 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.nan_to_num(b[:, r] / (high - low))
            wider[:, r] += part * (high - t)
            wider[:, r + 1] += part * (t - low)
        b = wider
    return at - 3, b


def _values(basis: tuple[np.ndarray, np.ndarray], c: np.ndarray) -> np.ndarray:
    first, b = basis
    return sum(b[:, r, None] * c[first + r] for r in range(4))


def _solve(diagonals: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x`` of the symmetric positive definite band matrix with three ``diagonals`` (row ``r``: entries ``i, i + r``) beside the main one.

    Blocks of three make it tridiagonal; every second block is eliminated until one is left, in memory linear in ``y``.
    """
    n, m = len(y), -(-len(y) // 3)
    if n <= 128:  # as one block, which is quicker
        full = np.zeros((n, n))
        for r in range(4):
            i = np.arange(n - r)
            full[i, i + r] = full[i + r, i] = diagonals[r, : n - r]
        return np.linalg.solve(full, y)
    band = np.zeros((4, 3 * m + 3))
    band[0, n:] = 1.0
    for r in range(4):
        band[r, : n - r] = diagonals[r, : n - r]
    right = np.zeros((3 * m, y.shape[1]))
    right[:n] = y
    main, upper, at = np.zeros((m, 3, 3)), np.zeros((m, 3, 3)), 3 * np.arange(m)
    for i in range(3):
        for j in range(3):
            main[:, i, j] = band[abs(i - j), at + min(i, j)]
            if j <= i:
                upper[:, i, j] = band[3 + j - i, at + i]
    return _halved(main, upper[:-1], right.reshape(m, 3, -1)).reshape(3 * m, -1)[:n]


def _halved(main: np.ndarray, upper: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cyclic reduction of a symmetric block-tridiagonal system: blocks at odd places are solved from their neighbours."""
    m = len(main)
    if m == 1:
        return np.linalg.solve(main, y)
    turned = lambda x: np.swapaxes(x, 1, 2)
    odd = np.arange(1, m, 2)
    inner = odd[odd + 1 < m]
    left, right = turned(upper[odd - 1]), upper[inner]  # what ties an odd block to the even one before and after it
    by_left, by_y = np.linalg.solve(main[odd], left), np.linalg.solve(main[odd], y[odd])
    by_right = np.linalg.solve(main[inner], right)
    even, even_y, k = main[::2].copy(), y[::2].copy(), len(inner)
    even[: len(odd)] -= turned(left) @ by_left
    even_y[: len(odd)] -= turned(left) @ by_y
    even[1 : k + 1] -= turned(right) @ by_right
    even_y[1 : k + 1] -= turned(right) @ by_y[:k]
    x = np.empty_like(y)
    x[::2] = _halved(even, -(turned(left[:k]) @ by_right), even_y)
    x[1::2] = by_y - by_left @ x[odd - 1]
    x[inner] -= by_right @ x[inner + 1]
    return x


def smoothing_spline(p: np.ndarray, smooth: float = 1.5, spacing: float = 1.0) -> np.ndarray:
    """Points every ``spacing`` on a cubic spline whose squared residuals sum to ``smooth`` times the number of points, or less.

    Knots double until the free fit is below that or there are as many coefficients as points; then a penalty on second differences grows, by
    bisection, until the sum is met. All systems are bands, so memory is linear in the curve. At most 200,000 points are returned.
    """
    steps = np.linalg.norm(np.diff(p, axis=0), axis=1)
    keep = np.concatenate([[True], steps > 1e-12])
    p, steps = p[keep], steps[steps > 1e-12]
    if len(p) < 5:
        return p
    s = np.concatenate([[0], np.cumsum(steps)])
    t, target, inner = s / s[-1], smooth * len(p), 8
    while True:
        inner = min(inner, len(p) - 4)
        knots = np.concatenate([[0] * 4, np.quantile(t, np.linspace(0, 1, inner + 2)[1:-1]), [1] * 4])
        basis, size = _basis(t, knots), inner + 4
        first, b = basis
        gram, moment = np.zeros((4, size)), np.zeros((size, p.shape[1]))
        for r in range(4):
            for q in range(r, 4):
                gram[q - r] += np.bincount(first + r, b[:, r] * b[:, q], size)
            for k in range(p.shape[1]):
                moment[:, k] += np.bincount(first + r, b[:, r] * p[:, k], size)
        rough, ones = np.zeros((4, size)), np.array([1.0, -2.0, 1.0])
        for r in range(3):
            for q in range(r, 3):
                rough[q - r, r : r + size - 2] += ones[r] * ones[q]
        ridge = np.array([[1e-12], [0], [0], [0]])
        solve = lambda w: _solve(gram + (w + 1e-9) * rough + ridge, moment)  # noqa: B023, E731
        residual = lambda c: float(((_values(basis, c) - p) ** 2).sum())  # noqa: B023, E731
        if residual(solve(0.0)) <= target or inner >= len(p) - 4:
            break
        inner *= 2
    lo, hi = -9.0, 9.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if residual(solve(10**mid)) <= target else (lo, mid)
    c = solve(10**lo)
    n = int(np.clip(round(s[-1] / spacing) + 1, 4, 200_000))
    return _values(_basis(np.linspace(0, 1, n), knots), c)


def fit_curves(curves: DataFrame, smooth: float = 1.5, spacing: float = 1.0) -> DataFrame:
    """``(sid, k, p0..p2)``: a smoothing spline through each ordered point set; a curve is what one task holds."""

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = smoothing_spline(rows.sort_values("k")[["p0", "p1", "p2"]].to_numpy(float), smooth, spacing)
        return pd.DataFrame({"sid": key[0], "k": np.arange(len(out))} | {f"p{i}": out[:, i] for i in range(3)})

    kind = curves.schema["sid"].dataType.simpleString()
    return curves.select("sid", "k", "p0", "p1", "p2").groupBy("sid").applyInPandas(rule, f"sid {kind}, k long, p0 double, p1 double, p2 double")


def without_repeats(curves: DataFrame, near: float = 6.0, share: float = 0.6) -> DataFrame:
    """Curves less those of which ``share`` or more of the points lie nearer than ``near`` to longer curves that stay.

    Curves are taken longest first (ties: the smaller id). In each round, a curve goes as soon as those that surely stay cover enough of it, and stays as soon as those that
    may still stay cover too little: what the rest comes to can't change that. So nobody waits for all longer neighbours; a chain in which each curve lies on the next alone still takes a round a link.
    """
    length = total_length(curves).select("sid", "length")
    points = curves.withColumn("id", F.monotonically_increasing_id())
    points = stored(points.join(length, "sid"), "points")
    pairs = neighbours(points.select("id", "p0", "p1", "p2", "sid", "length"), near, inclusive=False)
    longer = (F.col("b_length") > F.col("a_length")) | ((F.col("b_length") == F.col("a_length")) & (F.col("b_sid") < F.col("a_sid")))
    covers = pairs.where((F.col("a_sid") != F.col("b_sid")) & longer).select(F.col("a_sid").alias("sid"), F.col("a_id").alias("id"), F.col("b_sid").alias("over")).distinct()
    covers = stored(covers.withColumn("sure", F.lit(False)), "covers")  # ``sure``: the longer curve stays
    left = stored(points.groupBy("sid").agg(F.count("*").alias("n")), "left")
    rounds = []
    while not left.isEmpty():
        each = covers.groupBy("sid", "id").agg(F.max("sure").alias("sure")).groupBy("sid").agg(F.sum(F.col("sure").cast("long")).alias("hit"), F.count("*").alias("most"))
        judged = left.join(each, "sid", "left").withColumns({"hit": F.coalesce("hit", F.lit(0)), "most": F.coalesce("most", F.lit(0))})
        stays = F.when(F.col("hit") >= share * F.col("n"), False).when(F.col("most") < share * F.col("n"), True)
        judged = stored(judged.select("sid", "n", stays.alias("stays")), "judged")
        new = judged.where("stays is not null").select("sid", "stays")
        rounds.append(new)
        rest = stored(judged.where("stays is null").select("sid", "n"), "left")
        fates = new.select(F.col("sid").alias("over"), "stays")
        still = covers.join(rest.select("sid"), "sid", "left_semi").join(fates, "over", "left").where("stays is null or stays").select("sid", "id", "over", (F.col("sure") | F.coalesce("stays", F.lit(False))).alias("sure"))
        still = stored(still, "covers")
        discard(covers, left)
        covers, left = still, rest
    kept = None
    for new in rounds:
        staying = new.where("stays").select("sid")
        kept = staying if kept is None else kept.union(staying)
    return curves if kept is None else curves.join(kept, "sid", "left_semi")
