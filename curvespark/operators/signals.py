"""Shapes along curves: rigid fits, peaks, writhe, time warping, and segmentation by a template."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES
from curvespark.operators.curves import gaussian_smooth


def rigid_fit(pairs: DataFrame, group: str) -> DataFrame:
    """``(group, n, rms, r00..r22)``: the rotation that brings points ``a*`` closest to points ``b*``, without scale or reflection.

    Cross-covariances are sums, so the points aggregate map-side; only 3 x 3 matrices reach the linear algebra.
    """
    sums = [F.count("*").alias("n")]
    sums += [F.avg(f"{s}{k}").alias(f"m{s}{k}") for s in "ab" for k in AXES] + [F.sum(F.col(f"a{i}") * F.col(f"b{j}")).alias(f"c{i}{j}") for i in AXES for j in AXES]
    sums += [F.sum(sum((F.col(f"{s}{k}") * F.col(f"{s}{k}") for k in AXES[1:]), F.col(f"{s}0") * F.col(f"{s}0"))).alias(f"q{s}") for s in "ab"]
    stats = pairs.groupBy(group).agg(*sums)

    def solve(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            n = rows["n"].to_numpy(float)
            ma, mb = (rows[[f"m{s}{k}" for k in AXES]].to_numpy(float) for s in "ab")
            c = rows[[f"c{i}{j}" for i in AXES for j in AXES]].to_numpy(float).reshape(-1, 3, 3) - n[:, None, None] * ma[:, :, None] * mb[:, None, :]
            u, s, vt = np.linalg.svd(c)
            flip = np.sign(np.linalg.det(u) * np.linalg.det(vt))
            flip[flip == 0] = 1
            u[:, :, 2] *= flip[:, None]
            r = np.swapaxes(u @ vt, 1, 2)
            spread = rows["qa"] - n * (ma**2).sum(1) + rows["qb"] - n * (mb**2).sum(1)
            ssd = np.maximum(spread - 2 * (s[:, 0] + s[:, 1] + flip * s[:, 2]), 0)
            yield pd.DataFrame({group: rows[group], "n": rows["n"], "rms": np.sqrt(ssd / n)} | {f"r{i}{j}": r[:, i, j] for i in AXES for j in AXES})

    kind = stats.schema[group].dataType.simpleString()
    return stats.mapInPandas(solve, f"{group} {kind}, n long, rms double, " + ", ".join(f"r{i}{j} double" for i in AXES for j in AXES))


def symmetric_eigen(tensors: DataFrame, key: str) -> DataFrame:
    """``(key, l0..l2, t0..t2, linearity)`` of symmetric tensors ``xx, xy, xz, yy, yz, zz``: rising eigenvalues, the eigenvector of the smallest (its largest part is positive)."""

    def solve(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            v = np.nan_to_num(rows[["xx", "xy", "xz", "yy", "yz", "zz"]].to_numpy(float), posinf=0.0, neginf=0.0)
            m = v[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3) + 1e-8 * np.eye(3)
            values, vectors = np.linalg.eigh(m)
            t = vectors[:, :, 0]
            t = t * np.sign(np.take_along_axis(t, np.abs(t).argmax(1)[:, None], 1))
            out = {key: rows[key]} | {f"l{k}": values[:, k] for k in AXES} | {f"t{k}": t[:, k] for k in AXES}
            yield pd.DataFrame(out | {"linearity": (values[:, 1] - values[:, 0]) / (values[:, 1] + values[:, 0] + 1e-6)})

    kind = tensors.schema[key].dataType.simpleString()
    return tensors.select(key, "xx", "xy", "xz", "yy", "yz", "zz").mapInPandas(solve, f"{key} {kind}, l0 double, l1 double, l2 double, t0 double, t1 double, t2 double, linearity double")


def peaks(signal: DataFrame, column: str, height: float, apart: int, most: int) -> DataFrame:
    """``(sid, k, value)``: local maxima of at least ``height``, highest first, none within ``apart`` of a higher one, ``most`` a signal."""

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        x, k = rows[column].to_numpy(float), rows["k"].to_numpy()
        inner = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
        kept: list[int] = []
        for i in inner[np.argsort(-x[inner], kind="stable")]:
            if len(kept) < most and all(abs(k[i] - k[j]) >= apart for j in kept):
                kept.append(i)
        kept.sort()
        return pd.DataFrame({"sid": key[0], "k": k[kept], "value": x[kept]})

    kind = signal.schema["sid"].dataType.simpleString()
    return signal.select("sid", "k", column).groupBy("sid").applyInPandas(rule, f"sid {kind}, k long, value double")


def local_writhe(curves: DataFrame, half: int, sigma: float = 3.0, spacing: float = 1.0) -> DataFrame:
    """``(sid, k, writhe)``: the Gauss integral of an evenly spaced curve, smoothed, over the pairs of points within ``half`` of each point.

    Tangents are central differences, those at the ends their neighbours'. Null where the window leaves the curve, and on curves that it covers whole.
    Each pair of the band is a term once. A window's pairs are those that end by its last point less those that begin before its first one, so
    its sum is the difference of two running sums, whatever the window's width.
    """
    by = Window.partitionBy("sid").orderBy("k")
    smooth = gaussian_smooth(curves.select("sid", "k", "p0", "p1", "p2"), ["p0", "p1", "p2"], sigma)
    inner = {f"t{i}": (F.lead(f"p{i}").over(by) - F.lag(f"p{i}").over(by)) / (2 * spacing) for i in AXES}
    ends = {f"t{i}": F.coalesce(f"t{i}", F.lead(f"t{i}").over(by), F.lag(f"t{i}").over(by), F.lit(0.0)) for i in AXES}
    point = F.struct("k", *(f"{c}{i}" for c in "pt" for i in AXES))
    near = {"ahead": F.collect_list(point).over(by.rowsBetween(1, 2 * half)), "behind": F.collect_list(point).over(by.rowsBetween(-2 * half, -1))}
    rows = smooth.withColumns(inner).withColumns(ends).withColumns(near)

    def term(other: Column) -> Column:
        d = [F.col(f"p{i}") - other[f"p{i}"] for i in AXES]
        s, t = [F.col(f"t{i}") for i in AXES], [other[f"t{i}"] for i in AXES]
        turn = (s[1] * t[2] - s[2] * t[1]) * d[0] + (s[2] * t[0] - s[0] * t[2]) * d[1] + (s[0] * t[1] - s[1] * t[0]) * d[2]
        return 2 * turn / F.pow(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], 1.5)

    # a pair has the same term seen from either point: its other end's rows need no join
    total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + term(x))
    sums = rows.select("sid", "k", total("ahead").alias("begun"), total("behind").alias("ended"))
    sums = sums.withColumns({"begun": F.sum("begun").over(by), "ended": F.sum("ended").over(by), "n": F.count("*").over(Window.partitionBy("sid"))})
    whole = F.lead("ended", half).over(by) - F.coalesce(F.lag("begun", half + 1).over(by), F.lit(0.0))
    fits = (F.col("n") > 2 * half + 1) & (F.lag("k", half).over(by).isNotNull())
    return sums.select("sid", "k", F.when(fits, spacing**2 / (4 * math.pi) * whole).alias("writhe"))

def _warped(x: np.ndarray, template: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest warp of a template onto a stretch that ends at each sample, and where it begins; channels are columns.

    A row of the table is a running minimum: a cell is its own cost plus the best of the row above up to here, less what the cells before it add up to.
    """
    cost = lambda i: np.abs(template[i] - x) @ weights
    total, start = cost(0), np.arange(len(x))
    for i in range(1, len(template)):
        above, begun = total.copy(), start.copy()
        if len(x) > 1:
            back = total[:-1] <= total[1:]
            above[1:], begun[1:] = np.where(back, total[:-1], total[1:]), np.where(back, start[:-1], start[1:])
        sums = np.cumsum(cost(i))
        ahead = above - np.concatenate([[0.0], sums[:-1]])
        least = np.minimum.accumulate(ahead)
        taken = np.maximum.accumulate(np.where(ahead <= least, np.arange(len(x)), 0))
        total, start = least + sums, begun[taken]
    return total, start


def _channels(template: list[float] | list[list[float]], columns: str | list[str], weights: list[float] | None) -> tuple[np.ndarray, list[str], np.ndarray]:
    names = [columns] if isinstance(columns, str) else list(columns)
    given = np.asarray(template, float).reshape(len(names), -1).T if isinstance(columns, str) else np.asarray(template, float).T
    return given, names, np.asarray(weights if weights is not None else [1.0] * len(names), float)


def warping_costs(signal: DataFrame, template: list[float] | list[list[float]], columns: str | list[str] = "x", weights: list[float] | None = None) -> DataFrame:
    """``(sid, k, start, cost)``: for each sample of each signal the cheapest warp of the template onto a stretch that ends there (weighted absolute differences; a list a channel), and where that begins."""
    given, names, shares = _channels(template, columns, weights)

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        k = rows["k"].to_numpy()
        total, start = _warped(rows[names].to_numpy(float), given, shares)
        return pd.DataFrame({"sid": key[0], "k": k, "start": k[start], "cost": total})

    kind = signal.schema["sid"].dataType.simpleString()
    return signal.select("sid", "k", *names).groupBy("sid").applyInPandas(rule, f"sid {kind}, k long, start long, cost double")


def subsequence_warping(signal: DataFrame, template: list[float], column: str = "x") -> DataFrame:
    """``(sid, start, stop, cost)``: the stretch of each signal that a template warps onto most cheaply (absolute differences); of equal ones the first."""
    best = F.min(F.struct("cost", F.col("k").alias("stop"), "start")).alias("m")
    return warping_costs(signal, template, column).groupBy("sid").agg(best).select("sid", "m.start", "m.stop", "m.cost")


def cheapest_segments(lengths: DataFrame, candidates: DataFrame, gap: float) -> DataFrame:
    """``(sid, segment, start, stop, cost, total, gaps)``: stretches of each signal that don't overlap, chosen from ``candidates`` ``(sid, start, stop, cost)``, so that their costs and ``gap`` for each sample between them are least.

    ``lengths`` is ``(sid, n)``; samples are 0 to n - 1. A gap is preferred to a stretch as dear, and of stretches that end together the first. ``total`` and ``gaps`` are the signal's least cost and its samples in gaps; signals
    without a segment have no rows. A semi-Markov chain's best path: its durations are those of the candidates, all starts of one end are compared at once.
    """

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        rows = rows[rows["stop"].notna() & (rows["stop"] < n) & (rows["start"] >= 0) & (rows["start"] <= rows["stop"])].sort_values(["stop", "start", "cost"])
        start, stop, cost = rows["start"].to_numpy(int), rows["stop"].to_numpy(int), rows["cost"].to_numpy(float)
        first = np.searchsorted(stop, np.arange(n + 1))
        least, chosen = np.zeros(n + 1), np.full(n + 1, -1)
        for j in range(n):
            least[j + 1] = least[j] + gap
            a, b = first[j], first[j + 1]
            if a < b:
                ways = least[start[a:b]] + cost[a:b]
                k = int(np.argmin(ways))
                if ways[k] < least[j + 1]:
                    least[j + 1], chosen[j + 1] = ways[k], a + k
        taken, j, gaps = [], n, 0
        while j:
            if chosen[j] < 0:
                j, gaps = j - 1, gaps + 1
            else:
                taken.append(chosen[j])
                j = start[chosen[j]]
        taken.reverse()
        return pd.DataFrame({"sid": key[0], "segment": np.arange(len(taken)), "start": start[taken], "stop": stop[taken], "cost": cost[taken], "total": least[n], "gaps": gaps}) if taken else pd.DataFrame({c: [] for c in ("sid", "segment", "start", "stop", "cost", "total", "gaps")})

    kind = lengths.schema["sid"].dataType.simpleString()
    rows = lengths.select("sid", F.col("n").cast("long").alias("n")).join(candidates.select("sid", "start", "stop", "cost"), "sid", "left")
    return rows.groupBy("sid").applyInPandas(rule, f"sid {kind}, segment long, start long, stop long, cost double, total double, gaps long")


def hidden_segments(signal: DataFrame, template: list[float] | list[list[float]], columns: str | list[str] = "x", weights: list[float] | None = None, gap: float = 0.8, stretch: float = 1.5) -> DataFrame:
    """``cheapest_segments`` of the stretches that the template warps onto: the best one for each end, if it is neither ``stretch`` times longer than the template nor as much shorter (two samples at least)."""
    m = len(_channels(template, columns, weights)[0])
    shortest, longest = max(2, round(m / stretch)), round(m * stretch)
    ends = warping_costs(signal, template, columns, weights).where(f"k - start + 1 between {shortest} and {longest}")
    return cheapest_segments(signal.groupBy("sid").agg(F.count("*").alias("n")), ends.select("sid", "start", F.col("k").alias("stop"), "cost"), gap)


def _even(p: np.ndarray, n: int) -> np.ndarray:
    s = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
    at = np.linspace(0, s[-1], n)
    return np.stack([np.interp(at, s, p[:, k]) for k in AXES], 1)


def _fit(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(0), b - b.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[2] *= np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1
    return float(np.sqrt(max((a**2).sum() + (b**2).sum() - 2 * s.sum(), 0) / len(a)))


def segment_by_template(curves: DataFrame, template: list[tuple[float, float, float]], first: int = 0, variation: float = 0.3, most: float = 100.0, blend: float = 0.2, samples: int = 30, backward: bool = False) -> DataFrame:
    """``(sid, seg, a, b, cost)``: consecutive stretches that fit a template rigidly, from ``first`` on (seg 0, 1, ...), with ``backward`` also those before it (seg -1, -2, ...).

    From each end, the next one is sought among lengths within ``variation`` of what is expected; the smallest error wins, the first of several, and ends the walk if over
    ``most``. The expected length follows the found ones by ``blend``, on each side for itself. Stretches are compared in the curve's own direction on both sides. The walk is sequential, so a
    curve is what one task holds.
    """
    shape = np.asarray(template, float)
    even, length = _even(shape, samples), float(np.linalg.norm(np.diff(shape, axis=0), axis=1).sum())

    def walk(p: np.ndarray, turned: np.ndarray) -> list[tuple[int, int, float]]:
        """Stretches from the first point on; ``turned`` is the template in the direction of the walk."""
        s = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
        a, expected, out = 0, length, []
        while a < len(p) - 3:
            lo, hi = np.searchsorted(s, [s[a] + (1 - variation) * expected, s[a] + (1 + variation) * expected])
            ends = [e for e in range(max(int(lo), a + 3), min(int(hi), len(p) - 1) + 1) if s[e] > s[a]]
            costs = [_fit(_even(p[a : e + 1], samples), turned) for e in ends]
            if not costs or min(costs) > most:
                break
            e, cost = ends[int(np.argmin(costs))], min(costs)
            out.append((a, e, cost))
            expected = (1 - blend) * expected + blend * (s[e] - s[a])
            a = e
        return out

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.sort_values("k")[["p0", "p1", "p2"]].to_numpy(float)
        out = [(key[0], n, first + a, first + b, cost) for n, (a, b, cost) in enumerate(walk(p[first:], even))]
        if backward:  # both turned round: the same pairs of points meet as in the curve's own direction
            out += [(key[0], -1 - n, first - b, first - a, cost) for n, (a, b, cost) in enumerate(walk(p[: first + 1][::-1], even[::-1]))]
        return pd.DataFrame(out, columns=["sid", "seg", "a", "b", "cost"])

    kind = curves.schema["sid"].dataType.simpleString()
    return curves.select("sid", "k", "p0", "p1", "p2").groupBy("sid").applyInPandas(rule, f"sid {kind}, seg long, a long, b long, cost double")
