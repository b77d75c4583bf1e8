"""Ways to join loose ends, and how knotted the closed result is."""

from __future__ import annotations

import functools
import heapq
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES
from curvespark.plans.lineage import stored

#: Cells in which a curve's crossings are looked for are so many mean extents of its segments wide: about two copies a segment, where cells of one extent and their neighbours make ten.
CELL = 2


def matchings(left: int, right: int, most: int = 8) -> list[tuple[tuple[int, int], ...]]:
    """Ways to pair arms of one side with arms of the other, up to ``most``; arms that are left over stay loose."""
    pairs = (tuple(zip(range(left), chosen, strict=False)) if left <= right else tuple(zip(chosen, range(right), strict=False)) for chosen in itertools.permutations(range(max(left, right)), min(left, right)))
    return list(itertools.islice(pairs, most))


def choices(spark: SparkSession, ways: list[int], most: int = 20_000) -> DataFrame:
    """``(combo, choice)``: every choice of one way in each region, a number written in mixed radix; ValueError for more than ``most``."""
    total = math.prod(ways)
    if total > most:
        raise ValueError(f"{total} combinations")
    digits, weight = [], 1
    for n in reversed(ways):
        digits.insert(0, (F.floor(F.col("id") / weight) % n).cast("int"))
        weight *= n
    return spark.range(total).select(F.col("id").alias("combo"), F.array(*digits).alias("choice"))


def crossings(segments: DataFrame) -> DataFrame:
    """Proper crossings in the plane of pairs of segments ``(sid, k, x0, y0, x1, y1)``, with where on each they cross.

    Cells as wide as the longest segment make the search an equi-join.
    """
    most = segments.agg(F.max(F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)))).first()[0] or 1.0
    cell = max(most, 1e-9)
    placed = segments.withColumns({"cx": F.floor((F.col("x0") + F.col("x1")) / 2 / cell), "cy": F.floor((F.col("y0") + F.col("y1")) / 2 / cell)})
    a = placed.select(*(F.col(c).alias(f"a_{c}") for c in placed.columns))
    for c in ("cx", "cy"):
        a = a.withColumn(f"n{c}", F.explode(F.array(*(F.col(f"a_{c}") + s for s in (-1, 0, 1)))))
    b = placed.select(*(F.col(c).alias(f"b_{c}") for c in placed.columns))
    near = a.join(b, (F.col("a_sid") == F.col("b_sid")) & (F.col("ncx") == F.col("b_cx")) & (F.col("ncy") == F.col("b_cy")) & (F.col("a_k") + 1 < F.col("b_k")))
    return _crossed(near).select(F.col("a_sid").alias("sid"), F.col("a_k").alias("k"), F.col("b_k").alias("j"), "t", "u")


def _crossed(near: DataFrame) -> DataFrame:
    """Those pairs of segments a and b that cross properly, with where on each as ``t`` and ``u``."""
    d = lambda s, c: F.col(f"{s}_{c}1") - F.col(f"{s}_{c}0")
    near = near.withColumn("den", d("a", "x") * d("b", "y") - d("a", "y") * d("b", "x")).where("den <> 0")
    ox, oy = F.col("b_x0") - F.col("a_x0"), F.col("b_y0") - F.col("a_y0")
    near = near.withColumns({"t": (ox * d("b", "y") - oy * d("b", "x")) / F.col("den"), "u": (ox * d("a", "y") - oy * d("a", "x")) / F.col("den")})
    return near.where("t > 0 and t < 1 and u > 0 and u < 1")


def _colouring(under: np.ndarray, over: np.ndarray) -> list[dict[int, float]]:
    """The colouring matrix of crossings without its last row and column, a dictionary a row: at most three entries each."""
    order = np.argsort(under)
    n, ends = len(order), under[order]
    above = np.searchsorted(ends, over[order]) % n
    rows: list[dict[int, float]] = []
    for r in range(n - 1):
        row: dict[int, float] = {}
        for arc, weight in ((int(above[r]), 2.0), (r, -1.0), ((r + 1) % n, -1.0)):
            if arc < n - 1:
                row[arc] = row.get(arc, 0.0) + weight
        rows.append({c: x for c, x in row.items() if x})
    return rows


def _log_determinant(under: np.ndarray, over: np.ndarray) -> float:
    """The logarithm of the knot determinant of crossings, given by their places along the curve below and above; minus infinity if the matrix is singular.

    Arcs run from one under-crossing to the next, and each crossing says twice the arc over it equals the two that end at it. The matrix is eliminated as it is, sparse: the column with the
    fewest entries goes first, by the shortest row whose entry is a tenth of its largest or more, so memory follows the crossings and what elimination fills in, not their square.
    """
    rows = _colouring(under, over)
    columns: list[set[int]] = [set() for _ in rows]
    for r, row in enumerate(rows):
        for c in row:
            columns[c].add(r)
    queue = [(len(have), c) for c, have in enumerate(columns)]
    heapq.heapify(queue)
    total, gone = 0.0, [False] * len(rows)
    while queue:
        count, c = heapq.heappop(queue)
        have = columns[c]
        if gone[c] or count != len(have):
            continue  # an older entry of the queue
        if not have:
            return -math.inf
        largest = max(abs(rows[r][c]) for r in have)
        pivot = min((r for r in have if abs(rows[r][c]) >= 0.1 * largest), key=lambda r: (len(rows[r]), r))  # noqa: B023  used at once
        own = rows[pivot]
        value = own.pop(c)
        total += math.log(abs(value))
        gone[c] = True
        for k in own:
            columns[k].discard(pivot)
        for r in have:
            if r == pivot:
                continue
            row = rows[r]
            factor = row.pop(c) / value
            for k, x in own.items():
                now = row.get(k, 0.0) - factor * x
                if abs(now) > 1e-12 * (1 + abs(factor * x)):
                    if k not in row:
                        columns[k].add(r)
                    row[k] = now
                elif k in row:
                    del row[k]
                    columns[k].discard(r)
        columns[c] = set()
        for k in own:
            heapq.heappush(queue, (len(columns[k]), k))
    return total


def _from_log(size: float) -> tuple[float | None, float | None]:
    """The determinant, whole where its logarithm is below 25 and None beyond a double, and its decimal logarithm, None for 0."""
    if size < math.log(0.5):
        return 0.0, None
    return (float(round(math.exp(size))) if size < 25 else math.exp(size) if size < 709 else None), size / math.log(10)


def determinant(p: np.ndarray) -> float | None:
    """The knot determinant of a closed polyline, all of its vertices: 1 for the unknot, 3 for the trefoil, 5 for the figure of eight; 0 if the colouring matrix is singular.

    It is seen along the axis of least spread.
    """
    q = (p - p.mean(0)) @ np.linalg.svd(p - p.mean(0), full_matrices=False)[2].T
    d, n = np.roll(q, -1, 0) - q, len(q)
    under, over = [], []
    for i in range(n - 2):
        j = np.arange(i + 2, n - (i == 0))
        o = q[j] - q[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
            t, u = (o[:, 0] * d[j, 1] - o[:, 1] * d[j, 0]) / den, (o[:, 0] * d[i, 1] - o[:, 1] * d[i, 0]) / den
        hit = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        j, t, u = j[hit], t[hit], u[hit]
        below = q[i, 2] + t * d[i, 2] < q[j, 2] + u * d[j, 2]
        under.append(np.where(below, i + t, j + u))
        over.append(np.where(below, j + u, i + t))
    under, over = (np.concatenate(x) if x else np.empty(0) for x in (under, over))
    return _from_log(_log_determinant(under, over))[0] if len(under) else 1.0


def _closed_segments(curves: DataFrame) -> DataFrame:
    """``(sid, k, last, x0..z1, wx, wy)``: the segments of each closed curve, seen along its axis of least spread, whether it is the closing one and their mean extents.

    Points that repeat the one before them, or close the curve by themselves, are no vertices.
    """
    by, whole, names = Window.partitionBy("sid").orderBy("k"), Window.partitionBy("sid"), [f"p{k}" for k in AXES]
    equal = lambda pairs: functools.reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(b) for a, b in pairs))
    p = curves.select("sid", "k", *names).withColumn("again", equal((c, F.lag(c).over(by)) for c in names)).where("not again")
    p = p.withColumns({f"f{k}": F.first(f"p{k}").over(by) for k in AXES} | {"last": F.lead("k").over(by).isNull()})
    p = p.where(~(F.col("last") & equal((f"p{k}", F.col(f"f{k}")) for k in AXES)))
    p = stored(p.select("sid", (F.row_number().over(by) - 1).alias("k"), *names), "vertices")
    spread = p.groupBy("sid").agg(*(F.avg(c).alias(f"m{c[1]}") for c in names), *(F.covar_pop(f"p{i}", f"p{j}").alias(f"c{i}{j}") for i in AXES for j in AXES))

    def axes(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            vectors = np.linalg.eigh(np.nan_to_num(rows[[f"c{i}{j}" for i in AXES for j in AXES]].to_numpy(float)).reshape(-1, 3, 3))[1]
            yield rows[["sid", "m0", "m1", "m2"]].assign(**{f"{c}{k}": vectors[:, k, 2 - at] for at, c in enumerate("xyz") for k in AXES})

    kind = curves.schema["sid"].dataType.simpleString()
    seen = stored(spread.mapInPandas(axes, f"sid {kind}, " + ", ".join(f"{c}{k} double" for c in "mxyz" for k in AXES)), "axes")
    at = lambda c: sum(((F.col(f"p{k}") - F.col(f"m{k}")) * F.col(f"{c}{k}") for k in AXES), F.lit(0.0))
    out = p.join(seen, "sid").select("sid", "k", *(at(c).alias(f"{c}0") for c in "xyz"))
    out = out.withColumns({"last": F.lead("k").over(by).isNull()} | {f"f{c}": F.first(f"{c}0").over(by) for c in "xyz"} | {f"{c}1": F.lead(f"{c}0").over(by) for c in "xyz"})
    out = out.select("sid", "k", "last", *(f"{c}0" for c in "xyz"), *(F.when(F.col("last"), F.col(f"f{c}")).otherwise(F.col(f"{c}1")).alias(f"{c}1") for c in "xyz"))
    return out.withColumns({f"w{c}": F.avg(F.abs(F.col(f"{c}1") - F.col(f"{c}0"))).over(whole) for c in "xy"})


def _curve_crossings(segments: DataFrame) -> DataFrame:
    """``(sid, under, over)``: where along its curve each crossing passes below and above itself.

    A segment goes to all cells that it may pass, so two that cross share one, and both sides of the join are one shuffle. Segments longer than a cell go there piece by
    piece: less than two pieces a segment on the average, however long the closing one is. Pairs that share several cells are found several times and count once.
    """
    cells = lambda c, x: F.coalesce(F.try_divide(x, CELL * F.col(f"w{c}")), F.lit(0.0))
    extent = lambda c: cells(c, F.abs(F.col(f"{c}1") - F.col(f"{c}0")))
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(extent("x"), extent("y"))))
    placed = segments.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    for c in "xy":
        one, two = (cells(c, F.col(f"{c}0") + (F.col("piece") + at) / F.col("pieces") * (F.col(f"{c}1") - F.col(f"{c}0"))) for at in (0, 1))
        # a hundredth of a cell more, so that rounding loses none
        placed = placed.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.least(one, two) - 0.01), F.floor(F.greatest(one, two) + 0.01))))
    placed = placed.select("sid", "k", F.col("last").cast("int").alias("last"), *(f"{c}{e}" for c in "xyz" for e in (0, 1)), "cx", "cy")
    a, b = (placed.select(*(F.col(c).alias(f"{s}_{c}") for c in placed.columns)) for s in "ab")
    # neighbours don't cross, nor do the first segment and the closing one; as a comes before b, a_last is 0: it is there so that both sides have the same columns and filters
    apart = (F.col("a_k") + 1 < F.col("b_k")) & (F.col("a_k") >= F.col("a_last") + F.col("b_last"))
    near = a.join(b.hint("merge"), (F.col("a_sid") == F.col("b_sid")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")) & apart)
    height = lambda s, x: F.col(f"{s}_z0") + F.col(x) * (F.col(f"{s}_z1") - F.col(f"{s}_z0"))
    below, on_a, on_b = height("a", "t") < height("b", "u"), F.col("a_k") + F.col("t"), F.col("b_k") + F.col("u")
    found = _crossed(near).select(F.col("a_sid").alias("sid"), "a_k", "b_k", F.when(below, on_a).otherwise(on_b).alias("under"), F.when(below, on_b).otherwise(on_a).alias("over"))
    return found.repartition("sid").dropDuplicates(["sid", "a_k", "b_k"]).select("sid", "under", "over")  # whole curves are wanted next


def knot_determinants(curves: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(sid, det, log10_det)`` of each closed curve, from all of its vertices; a curve's crossings are what one task holds, in a sparse matrix.

    ``det`` is whole where its logarithm is below 25, null beyond a double; ``log10_det`` is null where ``det`` is 0. ``names`` has the curves' different ``sid`` where
    they are at hand; else the curves are read a second time for them.
    """

    def rule(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        det, log10 = _from_log(_log_determinant(rows["under"].to_numpy(), rows["over"].to_numpy()))
        return pd.DataFrame({"sid": [key[0]], "det": [det], "log10_det": [log10]}).astype({"det": float, "log10_det": float})

    kind = curves.schema["sid"].dataType.simpleString()
    crossed = _curve_crossings(_closed_segments(curves)).groupBy("sid").applyInPandas(rule, f"sid {kind}, det double, log10_det double").withColumn("crosses", F.lit(True))
    plain = F.col("crosses").isNull()
    return (curves.select("sid").distinct() if names is None else names.select("sid")).join(crossed, "sid", "left").select("sid", F.when(plain, 1.0).otherwise(F.col("det")).alias("det"), F.when(plain, 0.0).otherwise(F.col("log10_det")).alias("log10_det"))


def ranked(solutions: DataFrame, group: str, score: str) -> DataFrame:
    """``place`` by score, nulls last, and ``behind``, the distance to the best, in each group."""
    by = Window.partitionBy(group)
    return solutions.withColumn("place", F.rank().over(by.orderBy(F.asc_nulls_last(score)))).withColumn("behind", F.col(score) - F.min(score).over(by))
