"""Stencils over sparse volumes in blocks: every block gets the voxels of its halo too, so blocks are independent rows of a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespark.operators.signals import symmetric_eigen
from curvespark.plans.lineage import stored

AXES = ("z", "y", "x")
#: A worker keeps the filters' spectra if they take no more bytes than this; else each block computes them.
_SPECTRA_BYTES = 256 << 20


def hemisphere(n: int) -> np.ndarray:
    """Evenly spread unit directions (x, y, z) on the upper half of the sphere."""
    k = np.arange(n)
    z = (k + 0.5) / n
    r, angle = np.sqrt(1 - z * z), 2 * np.pi * k / ((1 + np.sqrt(5)) / 2)
    return np.stack([r * np.cos(angle), r * np.sin(angle), z], 1)


def gabor_kernel(direction: np.ndarray, sigma: float, frequency: float, reach: int) -> np.ndarray:
    """A complex wave along ``direction`` (of axes x, y, z) under a Gaussian of sum one; indices are z, y, x."""
    z, y, x = np.meshgrid(*[np.arange(-reach, reach + 1)] * 3, indexing="ij")
    window = np.exp(-(x * x + y * y + z * z) / (2 * sigma * sigma))
    return window / window.sum() * np.exp(2j * np.pi * frequency * (direction[0] * x + direction[1] * y + direction[2] * z))


def with_halo(volume: DataFrame, edge: int, halo: int) -> DataFrame:
    """Voxels dealt to the blocks (b_z, b_y, b_x) whose halo holds them: one row for each, seven more near a corner."""
    out = volume
    for a in AXES:
        out = out.withColumn(f"b_{a}", F.explode(F.sequence(F.floor((F.col(a) - halo) / edge), F.floor((F.col(a) + halo) / edge))))
    return out


def _dense(rows: pd.DataFrame, block: tuple[int, ...], edge: int, halo: int) -> np.ndarray:
    cube = np.zeros((edge + 2 * halo,) * 3)
    at = [rows[a].to_numpy() - b * edge + halo for a, b in zip(AXES, block, strict=True)]
    cube[at[0], at[1], at[2]] = rows["v"]
    return cube


def wrapped(volume: DataFrame, sizes: dict[str, int], halo: int) -> DataFrame:
    """The volume with copies of what lies within ``halo`` of either end of an axis beyond its other end, for each axis of ``sizes``: volumes that close on themselves there."""
    out = volume
    for a, n in sizes.items():
        shifts = F.array_compact(F.array(F.lit(0), F.when(F.col(a) < halo, F.lit(n)), F.when(F.col(a) >= n - halo, F.lit(-n))))
        out = out.withColumn(a, F.explode(F.transform(shifts, lambda s: (F.col(a) + s).cast("int"))))  # noqa: B023  used at once
    return out


def volume_sizes(volume: DataFrame) -> DataFrame:
    """``(sample, n_z, n_y, n_x)``: each volume's lengths, up to its last stored voxel."""
    return volume.groupBy("sample").agg(*((F.max(a) + 1).alias(f"n_{a}") for a in AXES))


def _near(stored_at: np.ndarray, reach: int) -> np.ndarray:
    """Which voxels have a stored one within ``reach`` along all axes."""
    out = stored_at
    for axis in range(3):
        sums = np.cumsum(np.pad(out.astype(np.int32), [(reach + 1, reach) if a == axis else (0, 0) for a in range(3)]), axis)
        n = out.shape[axis]
        out = np.take(sums, range(2 * reach + 1, 2 * reach + 1 + n), axis) - np.take(sums, range(n), axis) > 0
    return out


def structure_tensors(volume: DataFrame, directions: int = 128, sigma: float = 7.0, frequency: float = 0.05, reach: int = 21, edge: int = 64, wrap: dict[str, int] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``(sample, z, y, x, xx, xy, xz, yy, yz, zz, energy)`` of each voxel of the volume that the filters answer at: their squared responses times their directions' outer products, and the sum of their sizes.

    Those are all voxels, stored or empty, with a stored one within ``reach`` along each axis; everywhere else the responses are zero. The volume's ``sizes`` ``(sample, n_z, n_y, n_x)`` are ``volume_sizes`` if not given.
    What lies outside is zero, but along the axes of ``wrap`` (with their lengths) the volume closes on itself. A block of ``edge`` voxels a side and its
    halo is what one task holds; the filters' spectra are computed once in a task's worker.
    """
    spectra: list[np.ndarray] = []

    def bank() -> list[np.ndarray]:
        if not spectra:
            size = (edge + 4 * reach,) * 3
            spectra.extend(np.fft.fftn(gabor_kernel(d, sigma, frequency, reach), size) if directions * np.prod(size) * 16 <= _SPECTRA_BYTES else None for d in hemisphere(directions))
        return spectra

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = tuple(int(b) for b in key[1:])
        cube = _dense(rows, block, edge, reach)
        stored_at = _dense(rows.assign(v=1.0), block, edge, reach) > 0
        size = [n + 2 * reach for n in cube.shape]
        low = [max(0, b * edge) for b in block]
        high = [min(int(rows[f"n_{a}"].iloc[0]), (b + 1) * edge) for a, b in zip(AXES, block, strict=True)]
        core = np.zeros(cube.shape, bool)
        core[tuple(slice(max(0, lo - b * edge + reach), max(0, hi - b * edge + reach)) for lo, hi, b in zip(low, high, block, strict=True))] = True
        place = np.nonzero(core & _near(stored_at, reach))
        if not len(place[0]):
            return pd.DataFrame({c: np.zeros(0, np.int32 if c in AXES else float) for c in names}).astype({"sample": object})
        spectrum = np.fft.fftn(cube, size)
        at = [p + reach for p in place]
        sums, energy = np.zeros((6, len(place[0]))), np.zeros(len(place[0]))
        for d, known in zip(hemisphere(directions), bank(), strict=True):
            filtered = known if known is not None else np.fft.fftn(gabor_kernel(d, sigma, frequency, reach), size)
            power = np.abs(np.fft.ifftn(spectrum * filtered)[at[0], at[1], at[2]]) ** 2
            energy += np.sqrt(power)
            sums += power * np.array([d[0] * d[0], d[0] * d[1], d[0] * d[2], d[1] * d[1], d[1] * d[2], d[2] * d[2]])[:, None]
        return pd.DataFrame({"sample": key[0]} | {a: (p + b * edge - reach).astype(np.int32) for a, b, p in zip(AXES, block, place, strict=True)} | dict(zip(names[4:10], sums, strict=True)) | {"energy": energy}, columns=names)

    names = ["sample", "z", "y", "x", "xx", "xy", "xz", "yy", "yz", "zz", "energy"]
    kind = volume.schema["sample"].dataType.simpleString()
    sizes = sizes if sizes is not None else volume_sizes(volume)
    sizes = sizes.select("sample", *((F.lit(wrap[a]) if a in (wrap or {}) else F.col(f"n_{a}")).cast("int").alias(f"n_{a}") for a in AXES))
    around = wrapped(volume.select("sample", *AXES, "v"), wrap or {}, reach)
    blocks = with_halo(around.join(sizes, "sample"), edge, reach)
    return blocks.groupBy("sample", *(f"b_{a}" for a in AXES)).applyInPandas(rule, f"sample {kind}, z int, y int, x int, " + ", ".join(f"{c} double" for c in names[4:]))


def gaussian_volume(volume: DataFrame, sigma: float, columns: tuple[str, ...] = ("v",), edge: int = 64) -> DataFrame:
    """``(sample, z, y, x, ...)`` of each voxel that isn't empty, its ``columns`` smoothed one axis after the other with zeros outside.

    The window is ``int(4 * sigma + 1)`` wide, or one more to be odd. A block of ``edge`` voxels a side and its halo is what one task holds.
    """
    reach = (int(4 * sigma + 1) | 1) // 2
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = weights / weights.sum()

    def along(cube: np.ndarray, axis: int) -> np.ndarray:
        padded = np.pad(cube, [(reach, reach) if a == axis else (0, 0) for a in range(3)])
        n = cube.shape[axis]
        return sum(w * np.take(padded, range(k, k + n), axis) for k, w in enumerate(weights))

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = tuple(int(b) for b in key[1:])
        own = rows[np.logical_and.reduce([(rows[a] >= b * edge) & (rows[a] < (b + 1) * edge) for a, b in zip(AXES, block, strict=True)])]
        out = {"sample": [key[0]] * len(own)} | {a: own[a].to_numpy() for a in AXES}
        low = [int(rows[a].min()) for a in AXES]
        shape = [int(rows[a].max()) - m + 1 for a, m in zip(AXES, low, strict=True)]
        place, mine = ([r[a].to_numpy() - m for a, m in zip(AXES, low, strict=True)] for r in (rows, own))
        for c in columns:
            cube = np.zeros(shape)
            if len(own):
                cube[place[0], place[1], place[2]] = rows[c]
                for axis in range(3):
                    cube = along(cube, axis)
            out[c] = cube[mine[0], mine[1], mine[2]]
        return pd.DataFrame(out).astype({"sample": object})

    kind = volume.schema["sample"].dataType.simpleString()
    blocks = with_halo(volume.select("sample", *AXES, *columns), edge, reach)
    return blocks.groupBy("sample", *(f"b_{a}" for a in AXES)).applyInPandas(rule, f"sample {kind}, z int, y int, x int, " + ", ".join(f"{c} double" for c in columns))


TENSOR = ("xx", "xy", "xz", "yy", "yz", "zz")


def oriented_cloud(volume: DataFrame, energy: float = 32_000.0, linearity: float = 0.03, sigma: float = 7.0, ratio: float = 1.0, every: int = 1, **bank: object) -> DataFrame:
    """``(sample, p0..p2, d0..d2, energy, linearity)``: the whole way from a volume to the cloud of the voxels whose filters answer strongly and along a line.

    Structure tensors, smoothed by ``ratio`` times ``sigma`` (rounded, one at least); the direction is that of the least eigenvector, positions and directions are
    in the order z, y, x. Voxels over both limits stay, empty ones too, of them those whose places are multiples of ``every``. ``bank`` goes to ``structure_tensors``.
    """
    tensors = stored(structure_tensors(volume, sigma=sigma, **bank), "tensors")
    smooth = gaussian_volume(tensors, max(1, round(sigma * ratio)), TENSOR)
    place = ["sample", *AXES]
    solved = symmetric_eigen(smooth.withColumn("place", F.struct(*place)), "place")
    out = solved.select("place.*", "t0", "t1", "t2", "linearity").join(tensors.select(*place, "energy"), place)
    out = out.where((F.col("energy") > energy) & (F.col("linearity") > linearity))
    for a in AXES:
        out = out.where(F.col(a) % every == 0)
    return out.select("sample", *(F.col(a).cast("double").alias(f"p{k}") for k, a in enumerate(AXES)), F.col("t2").alias("d0"), F.col("t1").alias("d1"), F.col("t0").alias("d2"), "energy", "linearity")
