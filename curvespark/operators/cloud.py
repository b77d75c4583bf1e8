"""Operators on oriented point clouds (id, p0..p2, d0..d2, energy, linearity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = (0, 1, 2)


def dot(a: str, b: str) -> Column:
    return sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") for k in AXES[1:]), F.col(f"{a}0") * F.col(f"{b}0"))


def squared_distance(a: str, b: str) -> Column:
    each = [(F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in AXES]
    return each[0] + each[1] + each[2]


def normalise_directions(cloud: DataFrame) -> DataFrame:
    """Directions of length one; those of 1e-8 or less stay as they are."""
    n = F.sqrt(dot("d", "d"))
    return cloud.withColumns({f"d{k}": F.col(f"d{k}") / F.when(n > 1e-8, n).otherwise(F.lit(1.0)) for k in AXES})


def strong(cloud: DataFrame, energy: float, linearity: float) -> DataFrame:
    """Points over both thresholds."""
    return cloud.where((F.col("energy") > energy) & (F.col("linearity") > linearity))


def stride(cloud: DataFrame, every: int) -> DataFrame:
    """Points whose id is a multiple of ``every``: a preview."""
    return cloud.where(F.col("id") % every == 0)


def edge_trim(cloud: DataFrame, keep: float = 0.995) -> DataFrame:
    """Points inside the bounding box shrunk about its centre to ``keep`` of each side."""
    box = cloud.agg(*(f(f"p{k}").alias(f"{n}{k}") for k in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))))
    inside = [F.abs(F.col(f"p{k}") - (F.col(f"lo{k}") + F.col(f"hi{k}")) / 2) <= keep * (F.col(f"hi{k}") - F.col(f"lo{k}")) / 2 for k in AXES]
    return cloud.crossJoin(F.broadcast(box)).where(inside[0] & inside[1] & inside[2]).select(*cloud.columns)  # one row of six numbers


def voxel_bins(cloud: DataFrame, scale: float = 4.0) -> DataFrame:
    """The point with the smallest id of each cubic cell; a cell's side is ``scale`` times that of a point's share of the bounding box."""
    box = cloud.agg(F.count("*").alias("n"), *(f(f"p{k}").alias(f"{m}{k}") for k in AXES for f, m in ((F.min, "lo"), (F.max, "hi")))).first()
    if not box["n"]:
        return cloud
    volume = 1.0
    for k in AXES:
        volume *= max(box[f"hi{k}"] - box[f"lo{k}"], 1e-9)
    cell = scale * (volume / box["n"]) ** (1 / 3)
    placed = cloud.withColumns({f"c{k}": F.floor((F.col(f"p{k}") - F.lit(box[f"lo{k}"])) / cell) for k in AXES})
    first = placed.groupBy("c0", "c1", "c2").agg(F.min_by(F.struct(*cloud.columns), "id").alias("r"), F.count("*").alias("members"))
    return first.select("r.*", "members")


#: A grid cell's side in radii: wider cells make fewer copies of a point and more pairs to compare.
CELL = 3.0


def cell(p: str, radius: float) -> Column:
    """The number of the grid cell along one axis."""
    return F.floor(F.col(p) / (CELL * radius))


def cells_within(p: str, radius: float) -> Column:
    """The cells along one axis that ``radius`` reaches from a point, one or two (rounding is on the safe side)."""
    margin = F.lit(radius * (1 + 1e-9)) + F.abs(F.col(p)) * 1e-15
    side = CELL * radius
    return F.array_distinct(F.array(F.floor((F.col(p) - margin) / side), F.floor(F.col(p) / side), F.floor((F.col(p) + margin) / side)))


def neighbours(cloud: DataFrame, radius: float, inclusive: bool = True, half: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of different points no farther apart than ``radius``, with both points' columns (``a_`` and ``b_``) and ``d2``; only of points whose ``by`` columns are equal, if there are such.

    A grid makes the distance join an equi-join: one side goes to the cells that its radius reaches, but to no cell before its own, so each pair of cells meets once and a
    point has about three copies. The join sorts both sides: by their tables' sizes Spark would broadcast them, copies and all. ``half`` gives each pair
    once, with ``a_id < b_id``; else both ways are made of that. AQE splits cells that are very full.
    """
    names = cloud.columns
    a = cloud.select(*(F.col(c).alias(f"a_{c}") for c in names))
    for k in AXES:
        a = a.withColumn(f"n{k}", F.explode(cells_within(f"a_p{k}", radius)))
    there, own = F.struct(*(F.col(f"n{k}") for k in AXES)), F.struct(*(cell(f"a_p{k}", radius) for k in AXES))
    a = a.where(there >= own).withColumn("here", there == own)
    b = cloud.select(*(F.col(c).alias(f"b_{c}") for c in names)).withColumns({f"m{k}": cell(f"b_p{k}", radius) for k in AXES})
    d2 = squared_distance("a_p", "b_p")
    apart = F.when(F.col("here"), F.col("a_id") < F.col("b_id")).otherwise(F.col("a_id") != F.col("b_id"))
    close = d2 <= radius * radius if inclusive else d2 < radius * radius
    equal = close & apart
    for left, right in (*((f"n{k}", f"m{k}") for k in AXES), *((f"a_{c}", f"b_{c}") for c in by)):
        equal = (F.col(left) == F.col(right)) & equal
    joined = a.join(b.hint("merge"), equal).withColumn("d2", d2)
    first = F.col("a_id") < F.col("b_id") if half else F.col("forth")
    if not half:
        joined = joined.withColumn("forth", F.explode(F.array(F.lit(True), F.lit(False))))
    pick = lambda x, y, c: F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}")
    return joined.select(*(pick("a", "b", c) for c in names), *(pick("b", "a", c) for c in names), "d2")


def nearest(cloud: DataFrame, k: int, radius: float, inclusive: bool = True) -> DataFrame:
    """The ``k`` nearest neighbours of each point within ``radius``, ranked by distance and id.

    Spark limits the groups of such a rank before it shuffles them too (``WindowGroupLimit``, for ``k`` up to 1,000), so a task sends ``k`` neighbours of a point at most.
    """
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("d2", "b_id"))
    return neighbours(cloud, radius, inclusive).withColumn("rank", rank).where(F.col("rank") <= k)


def cone_links(cloud: DataFrame, reach: float, degrees: float = 30.0, offsets: bool = False) -> DataFrame:
    """Pairs within reach where the other point lies in the cone about either point's direction, forwards or backwards; points without a direction have no links.

    ``offsets`` adds ``e0`` to ``e2``, the way from ``a`` to ``b``, for steps on the same cloud: see ``meanshift.spring_step``.
    """
    import math

    least = math.cos(math.radians(degrees))
    pairs = neighbours(cloud.where(dot("d", "d") > 1e-12), reach, half=True).where("d2 > 0")
    along = [F.col(f"b_p{k}") - F.col(f"a_p{k}") for k in AXES]
    lean = lambda s: F.abs(along[0] * F.col(f"{s}_d0") + along[1] * F.col(f"{s}_d1") + along[2] * F.col(f"{s}_d2")) / F.nullif(F.sqrt("d2"), F.lit(0.0))
    more = [along[k].alias(f"e{k}") for k in AXES] if offsets else []
    return pairs.where((lean("a") >= least) | (lean("b") >= least)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.sqrt("d2").alias("rest"), *more)


def united_degree(cloud: DataFrame, radius: float, similarity: float = 0.85, most: int = 512, least: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, n, degree, saturated)``: the share of a point's neighbours whose direction agrees with its own, zero with fewer than ``least`` neighbours; and the point's ``keep`` columns."""
    near = nearest(cloud, most, radius, inclusive=False)
    agrees = F.when(F.abs(dot("a_d", "b_d")) >= similarity, 1.0).otherwise(0.0)
    found = near.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"), F.avg(agrees).alias("degree"))
    out = cloud.select("id", *keep).join(found, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("id", n.alias("n"), F.when(n >= least, F.col("degree")).otherwise(F.lit(0.0)).alias("degree"), (n == most).alias("saturated"), *keep)


def united_filter(cloud: DataFrame, radius: float, similarity: float = 0.85, keep: float = 0.85, most: int = 512) -> DataFrame:
    """Points whose united degree is over ``keep``."""
    good = united_degree(cloud, radius, similarity, most).where(F.col("degree") > keep).select("id")
    return cloud.join(good, "id", "left_semi")


def nearest_accepted(points: DataFrame, accepted: DataFrame, radius: float) -> DataFrame:
    """``(id, distance)`` of each point to the nearest accepted one within ``radius`` (null beyond it)."""
    a = points
    for k in AXES:
        a = a.withColumn(f"n{k}", F.explode(cells_within(f"p{k}", radius)))
    b = accepted.select(*(F.col(f"p{k}").alias(f"b_p{k}") for k in AXES)).withColumns({f"m{k}": cell(f"b_p{k}", radius) for k in AXES})
    d2 = squared_distance("p", "b_p")
    near = a.join(b.hint("merge"), (F.col("n0") == F.col("m0")) & (F.col("n1") == F.col("m1")) & (F.col("n2") == F.col("m2")) & (d2 <= radius * radius))
    found = near.groupBy("id").agg(F.sqrt(F.min(d2)).alias("distance"))
    return points.select("id").join(found, "id", "left")
