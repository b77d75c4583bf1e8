"""Ordered operators on polylines (sid, k, p0..p2): arc length, resampling, tangents, turns, signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES

def _by():  # noqa: ANN202
    return Window.partitionBy("sid")


def _order():  # noqa: ANN202
    return _by().orderBy("k")


def _step(lag: int = 1) -> Column:
    each = [F.col(f"p{k}") - F.lag(f"p{k}", lag).over(_order()) for k in AXES]
    return F.sqrt(each[0] * each[0] + each[1] * each[1] + each[2] * each[2])


def arc_length(curves: DataFrame) -> DataFrame:
    """``s``: length along the curve up to each point."""
    stepped = curves.withColumn("step", F.coalesce(_step(), F.lit(0.0)))
    return stepped.withColumn("s", F.sum("step").over(_order().rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def total_length(curves: DataFrame) -> DataFrame:
    """``(sid, n, length)``."""
    return curves.withColumn("step", _step()).groupBy("sid").agg(F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def _segments(curves: DataFrame) -> DataFrame:
    """Segments with their start and end along the curve, both ends' positions, and the curve's length."""
    at = arc_length(curves)
    ahead = {"s1": F.lead("s").over(_order())} | {f"q{k}": F.lead(f"p{k}").over(_order()) for k in AXES}
    whole = F.max("s").over(_by())
    return at.withColumns(ahead | {"total": whole}).where("s1 is not null")


def _targets(segments: DataFrame, points: Column) -> DataFrame:
    """The resampled places that fall on each segment: half-open, but for the curve's end, which falls on its last segment that has a length."""
    n = points
    per = F.col("total") / F.nullif(n - 1, F.lit(0))
    first, last = F.ceil(F.col("s") / per - 1e-9), F.ceil(F.col("s1") / per - 1e-9) - 1
    rows = segments.where("s1 > s and total > 0").withColumns({"n": n, "per": per, "last_one": F.col("s1") >= F.col("total")})
    top = F.when(F.col("last_one"), n - 1).otherwise(F.least(last, n - 1))
    rows = rows.withColumns({"from": first, "to": top}).where(F.col("from") <= F.col("to"))
    rows = rows.withColumn("j", F.explode(F.sequence("from", "to")))
    return rows.withColumn("u", F.least(F.greatest((F.col("j") * F.col("per") - F.col("s")) / (F.col("s1") - F.col("s")), F.lit(0.0)), F.lit(1.0)))


def resample(curves: DataFrame, points: int | None = None, spacing: float | None = None) -> DataFrame:
    """Evenly spaced points on each curve by linear interpolation, ends kept: ``points`` of them, or as many as ``spacing`` asks for (two at least).

    Each segment makes its own points, so there is no join. Curves without length give no points.
    """
    segments = _segments(curves)
    n = F.lit(points) if points else F.greatest(F.bround(F.col("total") / spacing, 0).cast("long"), F.lit(2))
    rows = _targets(segments, n)
    return rows.select("sid", F.col("j").cast("long").alias("k"), *((F.col(f"p{k}") + F.col("u") * (F.col(f"q{k}") - F.col(f"p{k}"))).alias(f"p{k}") for k in AXES))


def resample_hermite(curves: DataFrame, spacing: float) -> DataFrame:
    """Evenly spaced points by cubic Hermite pieces with Catmull-Rom tangents, four points at least."""
    at = arc_length(curves)
    back, ahead = (lambda c: F.coalesce(F.lag(c).over(_order()), F.col(c))), (lambda c: F.coalesce(F.lead(c).over(_order()), F.col(c)))
    tangents = {f"t{k}": (ahead(f"p{k}") - back(f"p{k}")) / F.nullif(ahead("s") - back("s"), F.lit(0.0)) for k in AXES}
    at = at.withColumns(tangents)
    nxt = {"s1": F.lead("s").over(_order()), "total": F.max("s").over(_by())} | {f"{b}{k}": F.lead(f"{a}{k}").over(_order()) for a, b in (("p", "q"), ("t", "v")) for k in AXES}
    n = F.greatest(F.bround(F.col("total") / spacing, 0).cast("long") + 1, F.lit(4))
    rows = _targets(at.withColumns(nxt).where("s1 is not null"), n)
    u, h = F.col("u"), F.col("s1") - F.col("s")
    a, b, c, d = 2 * u * u * u - 3 * u * u + 1, (u * u * u - 2 * u * u + u) * h, -2 * u * u * u + 3 * u * u, (u * u * u - u * u) * h
    return rows.select("sid", F.col("j").cast("long").alias("k"), *((a * F.col(f"p{k}") + b * F.col(f"t{k}") + c * F.col(f"q{k}") + d * F.col(f"v{k}")).alias(f"p{k}") for k in AXES))


def central_tangents(curves: DataFrame) -> DataFrame:
    """Tangents of length one from each point's neighbours (one-sided at the ends; zero where these coincide)."""
    each = {f"t{k}": F.coalesce(F.lead(f"p{k}").over(_order()), F.col(f"p{k}")) - F.coalesce(F.lag(f"p{k}").over(_order()), F.col(f"p{k}")) for k in AXES}
    out = curves.withColumns(each)
    size = F.sqrt(F.col("t0") * F.col("t0") + F.col("t1") * F.col("t1") + F.col("t2") * F.col("t2"))
    out = out.withColumn("size", size)
    return out.withColumns({f"t{k}": F.when(F.col("size") > 1e-12, F.col(f"t{k}") / F.col("size")).otherwise(0.0) for k in AXES}).drop("size")


def gaussian_smooth(curves: DataFrame, columns: list[str], sigma: float) -> DataFrame:
    """Columns smoothed along the index (``k`` from 0 on without gaps); beyond an end the curve is mirrored (its end value twice).

    What a point takes is among the rows within reach of it, mirrored or not, so a sliding frame holds it: there is no join, and no row has copies.
    """
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    total = sum(weights)
    frame = _order().rowsBetween(-reach, reach)
    rows = curves.withColumns({"__n": F.count("*").over(_by()), "__near": F.collect_list(F.struct("k", *columns)).over(frame)})
    at = lambda i: F.pmod(F.col("k") + i, 2 * F.col("__n"))
    place = lambda i: F.when(at(i) < F.col("__n"), at(i)).otherwise(2 * F.col("__n") - 1 - at(i)) - F.col("__near")[0]["k"]
    asked = F.transform(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w / total).alias("w")) for i, w in zip(range(-reach, reach + 1), weights, strict=True))), lambda x: F.struct(F.get("__near", place(x["i"]).cast("int")).alias("v"), x["w"].alias("w")))
    rows = rows.withColumn("__asked", asked)

    def mean(c: str) -> Column:
        term = lambda x: x["w"] * x["v"][c]
        return F.aggregate("__asked", F.lit(None).cast("double"), lambda acc, x: F.when(term(x).isNull(), acc).otherwise(F.coalesce(acc, F.lit(0.0)) + term(x)))

    return rows.withColumns({c: mean(c) for c in columns}).drop("__n", "__near", "__asked")


def curvature(curves: DataFrame, spacing: float = 1.0) -> DataFrame:
    """``kappa``: the size of the second difference of an evenly spaced curve, zero at the ends."""
    each = [(F.lead(f"p{k}").over(_order()) - 2 * F.col(f"p{k}") + F.lag(f"p{k}").over(_order())) / (spacing * spacing) for k in AXES]
    return curves.withColumn("kappa", F.coalesce(F.sqrt(each[0] * each[0] + each[1] * each[1] + each[2] * each[2]), F.lit(0.0)))


def turn_angles(curves: DataFrame, window: int = 3) -> DataFrame:
    """``angle`` in degrees between the chords of ``window`` points before and after each point, zero near the ends."""
    before = [F.col(f"p{k}") - F.lag(f"p{k}", window).over(_order()) for k in AXES]
    after = [F.lead(f"p{k}", window).over(_order()) - F.col(f"p{k}") for k in AXES]
    rows = curves.withColumns({f"x{k}": before[k] for k in AXES} | {f"y{k}": after[k] for k in AXES})
    norm = lambda s: F.sqrt(F.col(f"{s}0") * F.col(f"{s}0") + F.col(f"{s}1") * F.col(f"{s}1") + F.col(f"{s}2") * F.col(f"{s}2"))
    rows = rows.withColumns({"nx": norm("x"), "ny": norm("y")})
    cos = (F.col("x0") * F.col("y0") + F.col("x1") * F.col("y1") + F.col("x2") * F.col("y2")) / F.nullif(F.col("nx") * F.col("ny"), F.lit(0.0))
    angle = F.when((F.col("nx") >= 1e-8) & (F.col("ny") >= 1e-8), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    return rows.withColumn("angle", F.coalesce(angle, F.lit(0.0))).select(*curves.columns, "angle")


def split_at_turns(curves: DataFrame, degrees: float, window: int = 3) -> DataFrame:
    """``(sid, piece, k, …)``: curves cut where the turn is over ``degrees`` and the largest within the window; pieces share the cut, those of under three points go."""
    rows = turn_angles(curves, window).withColumn("n", F.count("*").over(_by()))
    inner = (F.col("k") >= window) & (F.col("k") < F.col("n") - window)
    most = F.max(F.when(inner, F.col("angle"))).over(_order().rowsBetween(-window, window))
    rows = rows.withColumn("cut", F.when(inner & (F.col("angle") > degrees) & (F.col("angle") >= most - 1e-9), 1).otherwise(0))
    rows = rows.withColumn("piece", F.sum("cut").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    both = F.when(F.col("cut") == 1, F.array(F.col("piece") - 1, F.col("piece"))).otherwise(F.array("piece"))
    rows = rows.select(*curves.columns, F.explode(both).alias("piece"))
    size = F.count("*").over(Window.partitionBy("sid", "piece"))
    return rows.withColumn("size", size).where("size >= 3").drop("size")


def trim_ends(curves: DataFrame, back: float, share: float = 0.45, least: int = 4) -> DataFrame:
    """Curves without what lies within ``back`` of either end (at most ``share`` of the length); curves that would keep under ``least`` points stay whole."""
    rows = arc_length(curves).withColumn("total", F.max("s").over(_by()))
    cut = F.least(F.lit(back), share * F.col("total"))
    rows = rows.withColumn("inside", (F.col("s") >= cut) & (F.col("total") - F.col("s") >= cut))
    kept = F.sum(F.when(F.col("inside"), 1).otherwise(0)).over(_by())
    return rows.withColumn("kept", kept).where((F.col("kept") < least) | F.col("inside")).select(*curves.columns)


def autocorrelation(signal: DataFrame, lags: int, column: str = "x") -> DataFrame:
    """``(sid, lag, r)`` for lags up to ``lags``: of the signal less its mean, as a share of lag 0 (null for a constant signal)."""
    rows = signal.withColumn("y", F.col(column) - F.avg(column).over(_by()))
    products = [F.sum(F.col("y") * F.col(f"y{j}")).alias(f"s{j}") for j in range(lags + 1)]
    ahead = rows.withColumns({f"y{j}": F.lead("y", j).over(_order()) for j in range(lags + 1)})
    sums = ahead.groupBy("sid").agg(*products)
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("lag"), (F.coalesce(f"s{j}", F.lit(0.0)) / F.nullif(F.col("s0"), F.lit(0.0))).alias("r")) for j in range(lags + 1))))
    return sums.select("sid", each.alias("e")).select("sid", "e.lag", "e.r")


def z_scores(signal: DataFrame, column: str = "x") -> DataFrame:
    """``z``: population z-scores, zero for a constant signal and for nulls."""
    std = F.stddev_pop(column).over(_by())
    return signal.withColumn("z", F.coalesce((F.col(column) - F.avg(column).over(_by())) / F.nullif(std, F.lit(0.0)), F.lit(0.0)))


def sliding_correlation(signal: DataFrame, template: DataFrame, column: str = "x") -> DataFrame:
    """``(sid, start, r)``: Pearson correlation of a short template ``(k, x)`` with each stretch of its length."""
    size = template.agg(F.count("*").alias("m")).first()["m"]
    given = template.select(F.col("k").alias("o"), F.col(column).alias("y"))
    placed = signal.join(F.broadcast(given), F.col("k") >= F.col("o")).withColumn("start", F.col("k") - F.col("o"))  # a row a template point
    return placed.groupBy("sid", "start").agg(F.corr(column, "y").alias("r"), F.count("*").alias("m")).where(F.col("m") == size).drop("m")


def softmax_rates(scores: DataFrame, group: str, score: str = "rms", temperature: float = 15.0) -> DataFrame:
    """``rate``: each score's share of exp(-score / temperature) in its group."""
    by = Window.partitionBy(group)
    e = F.exp(-(F.col(score) - F.min(score).over(by)) / temperature)
    return scores.withColumn("e", e).withColumn("rate", F.col("e") / F.sum("e").over(by)).drop("e")


def bezier_bridge(pairs: DataFrame, points: int, handle: float = 0.4) -> DataFrame:
    """Points of cubic Bezier bridges between ends ``a*`` and ``b*`` with outward tangents ``s*`` and ``t*``; handles are a share of the chord."""
    chord = F.sqrt(sum(((F.col(f"b{k}") - F.col(f"a{k}")) * (F.col(f"b{k}") - F.col(f"a{k}")) for k in AXES[1:]), (F.col("b0") - F.col("a0")) * (F.col("b0") - F.col("a0"))))
    rows = pairs.withColumn("chord", chord).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("u", F.col("k") / F.lit(points - 1))
    u, v = F.col("u"), 1 - F.col("u")
    out = []
    for k in AXES:
        a, b, reach = F.col(f"a{k}"), F.col(f"b{k}"), handle * F.col("chord")
        out.append((v * v * v * a + 3 * v * v * u * (a + reach * F.col(f"s{k}")) + 3 * v * u * u * (b + reach * F.col(f"t{k}")) + u * u * u * b).alias(f"p{k}"))
    return rows.select("sid", "k", *out)
