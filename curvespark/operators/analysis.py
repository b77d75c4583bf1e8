"""The analysis of curves as one chain: even samples, curvature, writhe, autocorrelation and the periods that stand out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.curves import curvature, gaussian_smooth, resample_hermite, total_length
from curvespark.operators.signals import local_writhe
from curvespark.plans.lineage import stored

#: Spacing of the samples, smoothing in samples, the least period in length, how many periods, the least height of one.
SPACING, SIGMA, LEAST_PERIOD, TOP, HEIGHT = 2.0, 3.0, 20.0, 5, 0.05
#: Curves of fewer samples are left out.
LEAST = 8


def samples(curves: DataFrame, spacing: float = SPACING, sigma: float = SIGMA, window: float | None = None) -> DataFrame:
    """``(sid, k, s, step, kappa, p*)`` of even samples of each curve of ``LEAST`` or more: how far along, the spacing, the curvature of the smoothed curve; with a ``window`` in length also ``writhe``."""
    even = stored(resample_hermite(curves.select("sid", "k", "p0", "p1", "p2"), spacing), "even")
    n = F.count("*").over(Window.partitionBy("sid"))
    along = even.withColumn("n", n).where(F.col("n") >= LEAST).join(total_length(curves).select("sid", "length"), "sid")
    bent = curvature(gaussian_smooth(even, ["p0", "p1", "p2"], sigma)).select("sid", "k", "kappa")
    rows = along.withColumn("step", F.col("length") / (F.col("n") - 1)).join(bent, ["sid", "k"])
    rows = rows.select("sid", "k", (F.col("k") * F.col("step")).alias("s"), "step", (F.col("kappa") / (F.col("step") * F.col("step"))).alias("kappa"), "p0", "p1", "p2")
    if window is None:
        return rows
    half = max(2, round(window / spacing))
    turned = local_writhe(even, half, sigma).select("sid", "k", "writhe")  # free of scale: steps cancel out
    return rows.join(turned, ["sid", "k"])


def correlations(signal: DataFrame, column: str = "kappa") -> DataFrame:
    """``(sid, lag, r)`` for all lags of each signal ``(sid, k, column)`` without its nulls: of its deviations from the mean, as a share of those with themselves; zero for a constant signal."""

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("k")[column].dropna().to_numpy(float)
        x = x - x.mean() if len(x) else x
        size = 1 << max(1, 2 * len(x) - 1).bit_length()
        sums = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: len(x)] if len(x) else x
        r = sums / sums[0] if len(x) and x.any() and sums[0] > 1e-12 else np.zeros(len(x))
        return pd.DataFrame({"sid": key[0], "lag": np.arange(len(x)), "r": r})

    kind = signal.schema["sid"].dataType.simpleString()
    return signal.select("sid", "k", column).groupBy("sid").applyInPandas(rule, f"sid {kind}, lag long, r double")


def periods(lags: DataFrame, steps: DataFrame, least: float = LEAST_PERIOD, top: int = TOP, height: float = HEIGHT) -> DataFrame:
    """``(sid, place, lag, length, height)``: the ``top`` highest peaks of each signal's correlations at ``least`` or more in length, in the order of their lags; none is within half the least lag of a higher one. ``steps`` is ``(sid, step)``."""

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("lag")
        step, r = float(rows["step"].iloc[0]), rows["r"].to_numpy(float)
        first = max(1, round(least / step))
        x = r[first:]
        inner = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
        kept: list[int] = []
        for i in inner[np.argsort(-x[inner], kind="stable")]:
            if len(kept) < top and all(abs(i - j) >= max(1, first // 2) for j in kept):
                kept.append(int(i))
        kept.sort()
        at = np.array(kept, int) + first
        return pd.DataFrame({"sid": [key[0]] * len(at), "place": np.arange(len(at)), "lag": at, "length": at * step, "height": r[at]})

    kind = lags.schema["sid"].dataType.simpleString()
    return lags.join(steps.select("sid", "step").distinct(), "sid").groupBy("sid").applyInPandas(rule, f"sid {kind}, place long, lag long, length double, height double")


def analyse(curves: DataFrame, spacing: float = SPACING, sigma: float = SIGMA, least_period: float = LEAST_PERIOD, top: int = TOP, window: float | None = None) -> dict[str, DataFrame]:
    """``samples``, their ``lags`` and ``periods``, and with a ``window`` also ``writhe_lags``, of signals with eight samples or more whose window fits."""
    even = stored(samples(curves, spacing, sigma, window), "samples")
    lags = stored(correlations(even), "lags")
    out = {"samples": even, "lags": lags, "periods": periods(lags, even.groupBy("sid").agg(F.first("step").alias("step")), least_period, top)}
    if window is not None:
        enough = even.groupBy("sid").agg(F.count("writhe").alias("n")).where(F.col("n") >= LEAST).select("sid")
        out["writhe_lags"] = correlations(even.join(enough, "sid", "left_semi"), "writhe")
    return out
