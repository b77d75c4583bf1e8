"""Thresholds and statistics of sparse volumes (one row for each voxel that isn't empty)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def normalised(volume: DataFrame, value: str = "v") -> DataFrame:
    """Values divided by the largest of their sample; samples without a positive value are left out."""
    most = volume.groupBy("sample").agg(F.max(value).alias("most")).where("most > 0")
    return volume.join(most, "sample").withColumn(value, F.col(value) / F.col("most")).drop("most")


def keep_share(volume: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Voxels of each sample, those at the threshold or above, and their share in per cent."""
    kept = F.sum(F.when(F.col(value) >= threshold, 1).otherwise(0))
    return volume.groupBy("sample").agg(F.count("*").alias("voxels"), kept.alias("kept"), F.round(100.0 * kept / F.count("*"), 6).alias("keep_pct"))


def histogram(volume: DataFrame, value: str = "v", bins: int = BINS) -> DataFrame:
    """``(sample, bin, n, lo, hi)`` over each sample's own range; the last bin holds its right edge."""
    ends = volume.groupBy("sample").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = volume.join(ends, "sample")
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) / width * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    return placed.groupBy("sample", place.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def otsu(volume: DataFrame, value: str = "v", bins: int = BINS) -> DataFrame:
    """``(sample, bin, threshold)``: the centre of the bin of the largest between-class variance, the first of several.

    Empty bins repeat the bin before them, so they are left out. A sample of one value has its own bin's centre.
    """
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    hist = histogram(volume, value, bins).withColumn("centre", centre).withColumn("m", F.col("n") * F.col("centre"))
    each = Window.partitionBy("sample")
    up = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.select("*", F.sum("n").over(up).alias("w1"), F.sum("m").over(up).alias("s1"), F.sum("n").over(each).alias("w"), F.sum("m").over(each).alias("s"))
    w2 = F.col("w") - F.col("w1")
    between = F.when(w2 > 0, F.col("w1") * w2 * F.pow(F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / F.nullif(w2, F.lit(0)), 2)).otherwise(F.lit(0.0))
    best = F.max_by(F.struct("bin", "centre"), F.struct(F.round(between, 3), -F.col("bin")))
    return sums.groupBy("sample").agg(best.alias("b")).select("sample", F.col("b.bin").alias("bin"), F.round("b.centre", 6).alias("threshold"))


def valley(volume: DataFrame, value: str = "v", bins: int = BINS, sigma: float = 3.0, least: float = 0.01, apart: int = 10) -> DataFrame:
    """``(sample, threshold)``: the lowest bin of the smoothed histogram between its two highest peaks; without two peaks, the 95th percentile.

    A histogram has ``bins`` rows a sample, so its rule runs on them as arrays. Peaks stand above ``least`` of the highest, ``apart`` bins from any higher one.
    """
    import numpy as np
    import pandas as pd

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(bins)
        counts[rows["bin"]] = rows["n"]
        reach = int(4 * sigma + 0.5)
        weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        smooth = np.convolve(np.pad(counts, reach, mode="symmetric"), weights / weights.sum(), "valid")
        inner = np.flatnonzero((smooth[1:-1] > smooth[:-2]) & (smooth[1:-1] >= smooth[2:])) + 1
        peaks: list[int] = []
        for k in inner[np.argsort(-smooth[inner], kind="stable")]:
            if smooth[k] >= least * smooth.max() and all(abs(k - p) >= apart for p in peaks):
                peaks.append(int(k))
        if len(peaks) < 2:
            return pd.DataFrame({"sample": [key[0]], "threshold": [None]})
        a, b = sorted(peaks[:2])
        k, lo, hi = a + int(np.argmin(smooth[a : b + 1])), rows["lo"].iloc[0], rows["hi"].iloc[0]
        return pd.DataFrame({"sample": [key[0]], "threshold": [lo + (k + 0.5) * (hi - lo) / bins]})

    kind = volume.schema["sample"].dataType.simpleString()
    found = histogram(volume, value, bins).groupBy("sample").applyInPandas(rule, f"sample {kind}, threshold double")
    high = volume.groupBy("sample").agg(F.percentile(F.col(value), F.lit(0.95)).alias("p95"))
    return found.join(high, "sample").select("sample", F.coalesce("threshold", "p95").alias("threshold"))


def summary(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Extent, mean, population deviation and quartiles (linear between values) of each column in each group."""
    found = []
    for c in columns:
        x = F.col(c)
        found += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.round(F.avg(x), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(x), 6).alias(f"{c}_std")]
        found += [F.round(F.percentile(x, F.lit(q)), 6).alias(f"{c}_p{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return df.groupBy(group).agg(F.count("*").alias("n"), *found)


def slice_positions(shape: int, slices: int = 30) -> list[int]:
    """Evenly placed slices from a tenth to nine tenths of an axis."""
    step = 0.8 / (slices - 1) if slices > 1 else 0.0
    return [int((0.1 + k * step) * shape) for k in range(slices)]


def diameter_parameters(radii: DataFrame, ratio: float = 1.4) -> DataFrame:
    """Filter parameters of each sample from the median of its radii: sigma, frequency and odd kernel size."""
    r = F.percentile("radius", F.lit(0.5))
    found = radii.where("radius > 0").groupBy("sample").agg(r.alias("r50"))
    sigma = F.greatest(F.lit(1), F.bround("r50", 0).cast("int"))
    return found.select("sample", "r50", (2 * F.col("r50")).alias("diameter"), sigma.alias("sigma"), (1 / (ratio * 2 * F.col("r50"))).alias("freq"), (2 * F.bround(3.0 * sigma, 0).cast("int") + 1).alias("kernel"))


def _inner_distance(mask):  # noqa: ANN001, ANN202
    """Exact distance of each set pixel to the nearest clear one: along rows first, then the lower envelope down each column."""
    import numpy as np

    h, w = mask.shape
    far = float(h + w)
    row = np.where(mask, far, 0.0)
    for x in range(1, w):
        row[:, x] = np.minimum(row[:, x], row[:, x - 1] + 1)
    for x in range(w - 2, -1, -1):
        row[:, x] = np.minimum(row[:, x], row[:, x + 1] + 1)
    out = np.full((h, w), np.inf)
    y = np.arange(h)
    for k in range(h):
        out = np.minimum(out, row[k][None, :] ** 2 + ((y - k) ** 2)[:, None])
    return np.sqrt(out)


def slice_radii(volume: DataFrame, axis: str = "z", value: str = "v", threshold: float = 0.0, least: int = 10) -> DataFrame:
    """``(sample, at, radius)``: in each slice across ``axis``, the distances to the background at the ridges of its mask; slices of under ``least`` voxels are left out.

    A ridge pixel is nowhere lower than its neighbours on a line through it, in two directions or more. A slice is what one task holds.
    """
    import numpy as np
    import pandas as pd

    a, b = (c for c in ("z", "y", "x") if c != axis)

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < least:
            return pd.DataFrame({"sample": [], "at": [], "radius": []}).astype({"sample": object, "at": "int32"})
        i, j = rows[a] - rows[a].min() + 1, rows[b] - rows[b].min() + 1
        mask = np.zeros((i.max() + 2, j.max() + 2), bool)
        mask[i, j] = True
        d = _inner_distance(mask)
        c = d[1:-1, 1:-1]
        lines = ((d[:-2, 1:-1], d[2:, 1:-1]), (d[1:-1, :-2], d[1:-1, 2:]), (d[:-2, :-2], d[2:, 2:]), (d[:-2, 2:], d[2:, :-2]))
        ridge = sum(((c >= u) & (c >= v)).astype(int) for u, v in lines) >= 2
        found = c[ridge & mask[1:-1, 1:-1]]
        return pd.DataFrame({"sample": key[0], "at": np.int32(key[1]), "radius": found})

    kind = volume.schema["sample"].dataType.simpleString()
    inside = volume.where(F.col(value) > threshold).select("sample", F.col(axis).alias("at"), a, b)
    return inside.groupBy("sample", "at").applyInPandas(rule, f"sample {kind}, at int, radius double")
