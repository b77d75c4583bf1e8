"""Spark data sources for array files: ``npz`` point clouds and ``nrrd`` volumes."""

from __future__ import annotations

import glob
import gzip
import io
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Files(DataSourceReader):
    """A partition for each file."""

    ending = ""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.options = options

    def partitions(self) -> list[_File]:
        found = glob.glob(os.path.join(self.path, "**", f"*{self.ending}"), recursive=True) if os.path.isdir(self.path) else [self.path]
        return [_File(x) for x in sorted(set(map(os.path.realpath, found)))]


class _NpzReader(_Files):
    ending = ".npz"

    def read(self, partition: _File):  # noqa: ANN201
        with np.load(partition.path, allow_pickle=False) as found:
            if "points" not in found or found["points"].ndim != 2 or found["points"].shape[1] != 3:
                raise ValueError(f"{partition.path}: no points of three coordinates")
            p = found["points"].astype(float)
            d = next((found[k].astype(float) for k in ("directions", "dirs") if k in found), np.zeros_like(p))
            if d.shape != p.shape:
                raise ValueError(f"{partition.path}: points and directions differ in number")
            extra = [found[k].astype(float) if k in found and found[k].shape[:1] == p.shape[:1] else np.full(len(p), np.nan) for k in ("energy", "linearity")]
        size = np.linalg.norm(d, axis=1, keepdims=True)
        d = np.divide(d, size, out=np.zeros_like(d), where=size > 1e-12)
        name = os.path.splitext(os.path.basename(partition.path))[0]
        columns = [pa.array([name] * len(p)), pa.array(np.arange(len(p)))] + [pa.array(np.ascontiguousarray(m[:, k])) for m in (p, d) for k in range(3)] + [pa.array(x, from_pandas=True) for x in extra]
        yield pa.RecordBatch.from_arrays(columns, names=["sample", "id", "p0", "p1", "p2", "d0", "d1", "d2", "energy", "linearity"])


class NpzSource(DataSource):
    """``spark.read.format("npz")``: clouds, directions of length one, missing energies and linearities null."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "sample string, id long, p0 double, p1 double, p2 double, d0 double, d1 double, d2 double, energy double, linearity double"

    def reader(self, schema) -> _NpzReader:  # noqa: ANN001
        return _NpzReader(self.options)


_KINDS = {"uint8": "u1", "uchar": "u1", "unsigned char": "u1", "int16": "i2", "short": "i2", "uint16": "u2", "ushort": "u2", "unsigned short": "u2", "int32": "i4", "int": "i4", "uint32": "u4", "float": "f4", "double": "f8"}


def parse_nrrd(data: bytes) -> np.ndarray:
    """The array of an attached NRRD file, raw or gzip, with the slowest axis first."""
    head, _, body = data.partition(b"\n\n")
    lines = head.decode("ascii", "replace").replace("\r", "").split("\n")
    if not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x and not x.startswith("#") and ":=" not in x)}
    coding = fields.get("encoding", "raw").lower()
    if coding in ("gzip", "gz"):
        body = gzip.GzipFile(fileobj=io.BytesIO(body)).read()
    elif coding != "raw":
        raise ValueError(f"encoding {coding}")
    kind = np.dtype(_KINDS[fields["type"].lower()]).newbyteorder("<" if fields.get("endian", "little") == "little" else ">")
    sizes = [int(x) for x in fields["sizes"].split()]
    return np.frombuffer(body, kind, int(np.prod(sizes))).reshape(sizes[::-1])


class _NrrdReader(_Files):
    ending = ".nrrd"

    def read(self, partition: _File):  # noqa: ANN201
        with open(partition.path, "rb") as file:
            volume = parse_nrrd(file.read())
        if volume.ndim != 3 or volume.max(initial=0) == 0:
            raise ValueError(f"{partition.path}: no volume with a value above zero")
        name = os.path.splitext(os.path.basename(partition.path))[0]
        for z in range(len(volume)):
            y, x = np.nonzero(volume[z])
            if len(y):
                columns = [pa.array([name] * len(y)), pa.array(np.full(len(y), z, np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(volume[z][y, x].astype(float))]
                yield pa.RecordBatch.from_arrays(columns, names=["sample", "z", "y", "x", "v"])


class NrrdSource(DataSource):
    """``spark.read.format("nrrd")``: voxels that aren't zero, a batch for each slice."""

    @classmethod
    def name(cls) -> str:
        return "nrrd"

    def schema(self) -> str:
        return "sample string, z int, y int, x int, v double"

    def reader(self, schema) -> _NrrdReader:  # noqa: ANN001
        return _NrrdReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (NpzSource, NrrdSource):
        spark.dataSource.register(source)
