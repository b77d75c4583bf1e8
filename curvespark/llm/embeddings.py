"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosines.

Vectors of length one whose cosine is 0.98 or more lie 0.2 apart at most. A hash is a quantised random projection; a table's bucket is a run of such hashes. Each
bucket is compared whole, in blocks, so large buckets are spread over tasks; a block returns counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespark.operators.components import connected_components
from curvespark.plans.lineage import stored

MIN_COSINE = 0.98
#: Width of a quantisation step in multiples of the largest distance of a link.
_STEP = 8.0
#: Chances that one hash agrees for vectors just near enough, and for vectors at right angles.
_NEAR, _FAR = 0.9, 0.41
_MISSED = 0.03
_HASHES = 12
BLOCK = 512
_SEED = 20


def tables_for(n: int) -> tuple[int, int]:
    """Hashes a table and tables: so many hashes that unrelated vectors of ``n`` seldom meet, and so many tables that few links are missed."""
    hashes = max(_HASHES, math.ceil(math.log(max(n, 2)) / -math.log(_FAR)))
    return hashes, math.ceil(math.log(_MISSED) / math.log(1 - _NEAR**hashes))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled by their largest part first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signer(hashes: int, tables: int, width: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    mix = np.cumprod(np.full(hashes, 0x9E3779B97F4A7C15, np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, float) for v in batch.column(1).to_pylist()]
            signs = []
            for v in vectors:
                d = len(v)
                if d not in drawn:
                    rng = np.random.default_rng((_SEED, d))
                    drawn[d] = rng.standard_normal((d, hashes * tables)), rng.uniform(0, width, hashes * tables)
                directions, shift = drawn[d]
                cells = np.floor((_unit(v[None])[0] @ directions + shift) / width).astype(np.int64).astype(np.uint64)
                runs = cells.reshape(tables, hashes) * mix
                runs ^= runs >> np.uint64(31)
                signs.append((runs * np.uint64(0xFF51AFD7ED558CCD)).sum(1).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.list_(pa.int64()))], names=["class", "signs"])

    return sign


def _compare(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by bucket and pair of blocks; a bucket's rows may lie in several batches."""

    def links(rows: pa.Table) -> Iterator[tuple[int, int, int]]:
        ids = rows.column("class").to_numpy()
        table, first, second = (rows.column(c)[0].as_py() for c in ("table", "first", "second"))
        x = _unit(np.array(rows.column("vector").to_pylist(), float))
        copies, signs, block = rows.column("copies").to_numpy(), np.array(rows.column("signs").to_pylist()), rows.column("block").to_numpy()
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        near = x[a] @ x[b].T >= least
        if first == second:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        seen = np.zeros_like(near)
        for t in range(table):  # a pair counts in the first table that it shares
            seen |= signs[a, t][:, None] == signs[b, t][None, :]
        new = near & ~seen
        counts = np.zeros(len(ids), np.int64)
        counts[a] += new @ copies[b]
        if first != second:
            counts[b] += copies[a] @ new
        roots = np.arange(len(ids))
        while True:  # the smallest member of each group of linked vectors
            low = roots.copy()
            np.minimum.at(low, a, np.where(near, roots[b][None, :], len(ids)).min(1))
            np.minimum.at(low, b, np.where(near, roots[a][:, None], len(ids)).min(0))
            low = low[low]
            if (low == roots).all():
                break
            roots = low
        for k in np.flatnonzero((counts > 0) | (roots != np.arange(len(ids)))).tolist():
            yield int(ids[k]), int(ids[roots[k]]), int(counts[k])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("label", "dim", "table", "bucket", "first", "second")
        held: list[pa.Table] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                found = list(links(pa.concat_tables(held).combine_chunks()))
                u, v, n = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            runs = list(zip(*(rows.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for k in range(len(runs) + 1):
                if k == len(runs) or runs[k] != runs[start]:
                    if last is not None and runs[start] != last:
                        yield from flush()
                        held.clear()
                    if start < len(runs):
                        held.append(rows.slice(start, k - start))
                        last = runs[start]
                    start = k
        yield from flush()

    return compare


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", least: float = MIN_COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row: its direct links, the smallest id that links reach, and whether that is its own.

    Vectors are compared only within equal labels (all, without ``label_col``) and equal lengths. Vectors that are null, zero, or hold null or non-finite
    components, and those with a null label, link with nothing. Equal vectors are one class with a number of copies; repeated rows count as copies. A null id names
    no component. About 97 % or more of the links are found, and none below ``least``.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = sound & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(sound, F.lit(False)), F.col("vector")))
    classes = rows.where("vector is not null").groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    hashes, tables = tables_for(classes.count())
    width = _STEP * math.sqrt(2 - 2 * least)
    signed = stored(classes.select("class", "vector").mapInArrow(_signer(hashes, tables, width), "class long, signs array<long>"), "signs")
    entry = classes.select("class", "label", F.size("vector").alias("dim")).join(signed, "class").select("class", "label", "dim", F.posexplode("signs").alias("table", "bucket"))
    key = ["label", "dim", "table", "bucket"]
    shared = entry.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1")
    entry = entry.join(shared, key).withColumn("blocks", F.ceil(F.col("members") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    entry = entry.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    entry = entry.select("class", *key, "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    full = entry.join(classes.select("class", "vector", "copies"), "class").join(signed, "class")
    spread = full.repartition(*key, "first", "second").sortWithinPartitions(*key, "first", "second")
    found = stored(spread.select(*key, "first", "second", "class", "block", "copies", "vector", "signs").mapInArrow(_compare(least), "u long, v long, n long"), "links")
    linked = found.groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "class")
    groups = connected_components(found.select("u", "v")).withColumnRenamed("node", "class")
    named = classes.join(linked, "class", "left").join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(smallest, "component").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(named, ["label", "vector"], "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
