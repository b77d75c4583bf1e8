"""Array files of other programs read and written by tasks, through any filesystem that Spark reads or Arrow writes.

Files are read as Spark's ``binaryFile`` rows, so listing, remote stores and the dealing out are Spark's; a file is what a task holds. A file of the formats below is one sample, so writers
gather a sample's rows.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("p0", "p1", "p2")


def _contents(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """``(path, sample, content)`` of the files below ``path`` with this ending, each once."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").load(path)
    return rows.dropDuplicates(["path"]).select("path", F.regexp_extract("path", rf"([^/]*){ending.replace('.', '[.]')}$", 1).alias("sample"), "content")


def _parsed(rows: DataFrame, rule: Callable[[str, np.lib.npyio.NpzFile], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sample, content in zip(batch["sample"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as found:
                    yield from rule(sample, found)

    return rows.select("sample", "content").mapInPandas(read, schema)


def _curve(sample: str, sid: int, p: np.ndarray, **more: object) -> pd.DataFrame:
    return pd.DataFrame({"sample": sample} | more | {"sid": sid, "k": np.arange(len(p))} | {c: p[:, i].astype(float) for i, c in enumerate(AXES)})


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """``(sample, sid, k, p*)`` of the centrelines in ``npz`` files: arrays ``curve_<n>``, numbered in the order of their names, or else every array of three columns and two rows or more.

    A file without any is an error that names it.
    """

    def rule(sample: str, found: np.lib.npyio.NpzFile) -> Iterator[pd.DataFrame]:
        good = lambda a: a.ndim == 2 and a.shape[1] == 3 and len(a) > 1 and a.dtype.kind in "fiu"
        arrays = [a for k in sorted(found) if k.startswith("curve_") and good(a := found[k])] or [a for k in found.files if good(a := found[k])]
        if not arrays:
            raise ValueError(f"{sample}: no curve among {found.files}")
        for sid, a in enumerate(arrays):
            yield _curve(sample, sid, a)

    return _parsed(_contents(spark, path, ".npz"), rule, "sample string, sid long, k long, p0 double, p1 double, p2 double")


def read_possibilities(spark: SparkSession, path: str) -> DataFrame:
    """``(sample, choice, ways, sid, k, p*)`` of files with several possible sets of curves: of each its ways by region. Files of one set alone have no rows."""

    def rule(sample: str, found: np.lib.npyio.NpzFile) -> Iterator[pd.DataFrame]:
        if "n_poss" not in found.files:
            return
        for choice in range(int(found["n_poss"])):
            ways = ",".join(str(int(x)) for x in found[f"p{choice}_combo"]) if f"p{choice}_combo" in found.files else ""
            for sid in range(int(found[f"p{choice}_n"])):
                if f"p{choice}_c{sid}" in found.files:
                    yield _curve(sample, sid, found[f"p{choice}_c{sid}"], choice=choice, ways=ways)

    return _parsed(_contents(spark, path, ".npz"), rule, "sample string, choice long, ways string, sid long, k long, p0 double, p1 double, p2 double")


def read_templates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(template, color, length)`` and ``(template, k, p*)`` of a library: a JSON list of names, colours and ``npy`` files beside it; entries whose file is missing are left out."""
    listed = spark.read.option("multiLine", "true").schema("name string, npy string, color array<double>").json(path)
    folder = path.rpartition("/")[0] or "."
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder)
    named = listed.withColumn("file", F.regexp_extract("npy", r"([^/]*)$", 1)).join(files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content"), "file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                p = np.load(io.BytesIO(content), allow_pickle=False).astype(float).reshape(-1, 3)
                yield pd.DataFrame({"template": name, "k": np.arange(len(p))} | {c: p[:, i] for i, c in enumerate(AXES)})

    points = named.select("name", "content").mapInPandas(read, "template string, k long, p0 double, p1 double, p2 double")
    from curvespark.operators.curves import total_length

    lengths = total_length(points.withColumnRenamed("template", "sid")).select(F.col("sid").alias("template"), "length")
    return named.select(F.col("name").alias("template"), "color").join(lengths, "template"), points


def _write(folder: str, name: str, data: bytes) -> str:
    """Put a file in place as a whole: a task that runs again replaces it."""
    files, place = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
    files.create_dir(place, recursive=True)
    with files.open_output_stream(f"{place}/.{name}.part") as out:
        out.write(data)
    files.move(f"{place}/.{name}.part", f"{place}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def _saved(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def write_clouds(cloud: DataFrame, folder: str) -> DataFrame:
    """Write each sample ``(sample, id, p*, d*, ...)`` as an ``npz`` file of points and directions in the order of ids, further columns beside them row by row; returns ``(sample, path, points)``. A sample is what one task holds."""
    extra = [c for c in cloud.columns if c not in ("sample", "id", "p0", "p1", "p2", "d0", "d1", "d2")]

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        arrays = {"points": rows[list(AXES)].to_numpy(np.float32), "directions": rows[["d0", "d1", "d2"]].to_numpy(np.float32)} | {c: rows[c].to_numpy() for c in extra}
        return pd.DataFrame({"sample": [key[0]], "path": [_write(folder, f"{key[0]}.npz", _saved(arrays))], "points": [len(rows)]})

    from curvespark.plans.lineage import stored

    return stored(cloud.groupBy("sample").applyInPandas(rule, "sample string, path string, points long"), "written")


def write_curves(curves: DataFrame, folder: str) -> DataFrame:
    """Write each sample ``(sample, sid, k, p*)`` as an ``npz`` file with an array a curve, renumbered from 0 by their ids, and ``yarn`` if there is one only; returns ``(sample, path, curves)``."""

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        each = [own.sort_values("k")[list(AXES)].to_numpy(float) for _, own in rows.groupby("sid")]
        arrays = {f"curve_{i}": p for i, p in enumerate(each)} | {"sub_ids": np.arange(len(each)), "n_curves": np.asarray(len(each)), "fmt": np.asarray("yarn_state_v1")}
        if len(each) == 1:
            arrays["yarn"] = each[0]
        return pd.DataFrame({"sample": [key[0]], "path": [_write(folder, f"{key[0]}.npz", _saved(arrays))], "curves": [len(each)]})

    from curvespark.plans.lineage import stored

    return stored(curves.groupBy("sample").applyInPandas(rule, "sample string, path string, curves long"), "written")


def write_volumes(volume: DataFrame, folder: str, sizes: DataFrame | None = None) -> DataFrame:
    """Write each sample ``(sample, z, y, x, v)`` as an NRRD file of 16-bit numbers, empty voxels zero; returns ``(sample, path, voxels)``. ``sizes`` are ``filters.volume_sizes`` if not given; values are rounded and kept within 0 to 65,535."""
    from curvespark.operators.filters import volume_sizes
    from curvespark.plans.lineage import stored

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shape = tuple(int(rows[f"n_{a}"].iloc[0]) for a in "zyx")
        cube = np.zeros(shape, "<u2")
        cube[rows["z"], rows["y"], rows["x"]] = np.clip(np.rint(rows["v"]), 0, 65_535)
        head = f"NRRD0004\ntype: uint16\ndimension: 3\nsizes: {shape[2]} {shape[1]} {shape[0]}\nencoding: raw\nendian: little\n\n"
        return pd.DataFrame({"sample": [key[0]], "path": [_write(folder, f"{key[0]}.nrrd", head.encode() + cube.tobytes())], "voxels": [len(rows)]})

    rows = volume.select("sample", "z", "y", "x", "v").join(sizes if sizes is not None else volume_sizes(volume), "sample")
    return stored(rows.groupBy("sample").applyInPandas(rule, "sample string, path string, voxels long"), "written")


def save_extraction(segments: DataFrame, path: str, expected: float) -> None:
    """Write what was extracted ``(sid, segment, start, stop, ...)`` as Parquet, with the expected length beside it as JSON lines."""
    segments.write.mode("overwrite").parquet(f"{path.rstrip('/')}/segments")
    line = segments.sparkSession.range(1).select(F.lit(json.dumps({"expected": expected})).alias("value"))
    line.write.mode("overwrite").text(f"{path.rstrip('/')}/settings")


def load_extraction(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """The segments, and the length to expect next: the median of theirs, or the saved one if there are none."""
    segments = spark.read.parquet(f"{path.rstrip('/')}/segments")
    median = segments.agg(F.percentile(F.col("stop") - F.col("start"), F.lit(0.5))).first()[0]
    saved = spark.read.schema("expected double").json(f"{path.rstrip('/')}/settings").first()
    return segments, float(median if median is not None else saved["expected"])


def span(curves: DataFrame, segments: DataFrame) -> DataFrame:
    """``(template, k, p*)``: the stretch ``(sid, start, stop, template)`` of each curve as a template of its own."""
    rows = curves.join(segments.select("sid", "start", "stop", "template"), "sid").where("k between start and stop")
    return rows.select("template", (F.col("k") - F.col("start")).alias("k"), *AXES)
