"""Anisotropic mean shift of oriented clouds, and springs along frozen links."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES, cone_links, dot, nearest, normalise_directions
from curvespark.plans.lineage import stored


@dataclass(frozen=True)
class ShiftParameters:
    """Bandwidths from first to last step, kernel shape, neighbours, and the links that lock the cloud."""

    steps: int = 20
    first: float = 30.0
    last: float = 10.0
    alpha: float = 2.0
    most: int = 128
    gamma: float = 0.1
    along: float = 1.0
    across: float = 2.0
    ratio: float = 2.0
    turn: bool = True
    lock_at: int = 5
    cone: float = 30.0
    reach: float = 10.0
    weight: float = 1.0


#: What each variant of the published comparison changes.
ABLATIONS = {
    "full": {},
    "without_anisotropy": {"ratio": 1.0, "across": 1.0, "alpha": 0.0},
    "without_turning": {"turn": False},
    "without_damping": {"gamma": 0.0},
    "without_lock": {"weight": 0.0},
    "constant_30": {"first": 30.0, "last": 30.0, "weight": 0.0},
    "constant_10": {"first": 10.0, "last": 10.0},
}


def ablated(parameters: ShiftParameters, name: str) -> ShiftParameters:
    return replace(parameters, **ABLATIONS[name])


def bandwidth(step: int, p: ShiftParameters) -> float:
    """Between the first and the last bandwidth on a logarithmic scale."""
    return p.first if p.steps < 2 else p.first * (p.last / p.first) ** (step / (p.steps - 1))


def bandwidth_at(step: Column, p: ShiftParameters) -> Column:
    """The same for a column of steps."""
    return F.lit(p.first) if p.steps < 2 else p.first * F.pow(F.lit(p.last / p.first), step / (p.steps - 1))


def _kernel(bw: float, p: ShiftParameters) -> tuple[Column, Column]:
    """The weight of a pair, and the neighbour's offset along the point's direction."""
    along = sum(((F.col(f"b_p{k}") - F.col(f"a_p{k}")) * F.col(f"a_d{k}") for k in AXES[1:]), (F.col("b_p0") - F.col("a_p0")) * F.col("a_d0"))
    lateral = F.greatest(F.col("d2") - along * along, F.lit(0.0))
    wide, narrow = (bw * p.ratio) ** 2, bw**2
    inside = along * along / wide + lateral / narrow <= 1.0
    near = F.exp(-(p.along * along * along / (2 * wide) + p.across * lateral / (2 * narrow)))
    return F.when(inside, near * F.pow(F.abs(dot("a_d", "b_d")), F.lit(p.alpha))).otherwise(0.0), along


def _longest(bw: float, p: ShiftParameters) -> float:
    """The kernel's longer half-axis."""
    return bw * max(p.ratio, 1.0)


def step_neighbours(cloud: DataFrame, bw: float, *variants: ShiftParameters) -> DataFrame:
    """The neighbours that steps of all ``variants`` ask for, to be stored and given to each: ranks count within any smaller reach as well."""
    columns = [F.col(f"{s}_{c}") for s in "ab" for c in ("id", *(f"{x}{k}" for x in "pd" for k in AXES))]
    return nearest(cloud, max(p.most for p in variants), max(_longest(bw, p) for p in variants)).select(*columns, "d2", "rank")


def shift_step(cloud: DataFrame, bw: float, p: ShiftParameters = ShiftParameters(), near: DataFrame | None = None) -> DataFrame:
    """The cloud after one step: each point moves to its neighbours' weighted mean, across its own direction, and its direction turns to theirs.

    The kernel ends at an ellipsoid, so the neighbours within its longer half-axis are all that count; of them, the ``most`` nearest are taken.
    ``near`` may give them, and more: see ``step_neighbours``.
    """
    reach = _longest(bw, p)
    near = nearest(cloud, p.most, reach) if near is None else near.where((F.col("d2") <= reach * reach) & (F.col("rank") <= p.most))
    weight, along = _kernel(bw, p)
    side = F.when(dot("a_d", "b_d") < 0, -1.0).otherwise(1.0)
    near = near.withColumns({"w": weight, "t": F.signum(along), "side": side})
    sums = [F.sum("w").alias("w"), F.sum(F.col("w") * F.col("t")).alias("wt")]
    sums += [F.sum(F.col("w") * F.col(f"b_p{k}")).alias(f"m{k}") for k in AXES] + [F.sum(F.col("w") * F.col("side") * F.col(f"b_d{k}")).alias(f"n{k}") for k in AXES]
    out = cloud.join(near.groupBy(F.col("a_id").alias("id")).agg(*sums), "id", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    has = F.col("w") > 1e-12
    out = out.withColumns({f"m{k}": F.when(has, F.col(f"m{k}") / F.nullif(F.col("w"), F.lit(0.0)) - F.col(f"p{k}")).otherwise(0.0) for k in AXES})
    out = out.withColumn("s", dot("m", "d")).withColumns({f"p{k}": F.col(f"p{k}") + F.col(f"m{k}") - F.col("s") * F.col(f"d{k}") for k in AXES})
    if p.turn:
        size = F.sqrt(dot("n", "n"))
        out = out.withColumn("size", F.coalesce(size, F.lit(0.0)))
        damp = 1 - F.pow(F.abs(F.coalesce("wt", F.lit(0.0))) / (F.col("w") + 1e-12), F.lit(p.gamma))
        out = out.withColumn("damp", damp)
        mean = lambda k: F.when(F.col("size") > 1e-8, F.col(f"n{k}") / F.nullif(F.col("size"), F.lit(0.0))).otherwise(F.col(f"d{k}"))
        out = out.withColumns({f"n{k}": F.col("damp") * mean(k) + (1 - F.col("damp")) * F.col(f"d{k}") for k in AXES})
        length = F.sqrt(dot("n", "n"))
        out = out.withColumn("size", length).withColumns({f"d{k}": F.col(f"n{k}") / F.when(F.col("size") > 1e-8, F.col("size")).otherwise(1.0) for k in AXES})
    return out.select(*cloud.columns)


def spring_step(cloud: DataFrame, links: DataFrame, weight: float = 1.0, cap: float = 10.0) -> DataFrame:
    """The cloud after its links (a, b, rest) have pulled or pushed their ends towards the rest length; a point takes its links' mean, ``cap`` at most.

    Links that were just made of this cloud may bring their offsets ``e0`` to ``e2``; the ends of others are looked up where the cloud is now.
    """
    seg = links
    if "e0" not in links.columns:
        at = cloud.select("id", *(f"p{k}" for k in AXES))
        a, b = (at.select(F.col("id").alias(s), *(F.col(f"p{k}").alias(f"{s}{k}") for k in AXES)) for s in "ab")
        seg = links.join(a, "a").join(b, "b").withColumns({f"e{k}": F.col(f"b{k}") - F.col(f"a{k}") for k in AXES})
    seg = seg.withColumn("len", F.sqrt(dot("e", "e"))).where("len > 1e-9")
    pull = {f"f{k}": weight * (F.col("len") - F.col("rest")) * F.col(f"e{k}") / F.col("len") for k in AXES}
    seg = seg.withColumns(pull)
    both = [F.struct(F.col(end).alias("id"), *((sign * F.col(f"f{k}")).alias(f"f{k}") for k in AXES)) for end, sign in (("a", 1.0), ("b", -1.0))]
    ends = seg.select(F.inline(F.array(*both)))  # not a union, which would find the links twice
    moved = ends.groupBy("id").agg(*(F.avg(f"f{k}").alias(f"f{k}") for k in AXES))
    size = F.sqrt(dot("f", "f"))
    moved = moved.withColumn("size", size).withColumn("by", F.when(F.col("size") > cap, cap / F.nullif(F.col("size"), F.lit(0.0))).otherwise(1.0))
    out = cloud.join(moved, "id", "left")
    return out.withColumns({f"p{k}": F.col(f"p{k}") + F.coalesce(F.col(f"f{k}") * F.col("by"), F.lit(0.0)) for k in AXES}).select(*cloud.columns)


def mean_shift(cloud: DataFrame, p: ShiftParameters = ShiftParameters(), history: bool = False) -> DataFrame:
    """All steps; each is written to the shared folder, which cuts the lineage. ``history`` gives every step's cloud, told apart by ``iter``."""
    now = stored(normalise_directions(cloud), "cloud")
    links, kept = None, [now.withColumn("iter", F.lit(0))]
    for step in range(p.steps):
        moved = shift_step(now, bandwidth(step, p), p)
        if links is not None and p.weight > 0:
            moved = spring_step(stored(moved, "moved"), links, p.weight, p.reach)
        now = stored(moved, "cloud")
        kept.append(now.withColumn("iter", F.lit(step + 1)))
        if step + 1 == p.lock_at:
            links = stored(cone_links(now, p.reach, p.cone), "links")
    if not history:
        return now
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out
