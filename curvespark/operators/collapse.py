"""Solving collapsed regions: every combination of the regions' ways to join curve ends, which of them close no loop, and the least knotted one.

A way is a set of joins between curve ends; a combination takes a way for each region of a sample. Combinations, their joins and their chains are relations: a
combination's number in mixed radix tells its ways, and curves are chained by pointers that double, for all combinations at once. Chains that occur in several
combinations are assembled and scored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES
from curvespark.operators.curves import bezier_bridge
from curvespark.operators.joining import _unit
from curvespark.operators.knots import knot_determinants
from curvespark.plans.lineage import discard, numbered, stored

#: Samples with more combinations than this are not solved.
MOST = 20_000


def combinations(ways: DataFrame, most: int = MOST) -> DataFrame:
    """``(sample, choice, region, way)``: all combinations of the ways ``(sample, region, way, ...)``, numbered from 0, the first region's ways changing slowest; samples with over ``most`` are left out."""
    counts = ways.groupBy("sample", "region").agg(F.countDistinct("way").alias("n"))
    later = Window.partitionBy("sample").orderBy(F.desc("region"))
    logs = counts.withColumn("bits", F.sum(F.log2("n")).over(Window.partitionBy("sample"))).where(F.col("bits") < 62)
    product = F.aggregate(F.collect_list("n").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1).cast("long"), lambda acc, x: acc * x)
    counts = logs.withColumn("below", product).withColumn("total", F.max(F.col("below") * F.col("n")).over(Window.partitionBy("sample"))).where(F.col("total") <= most)
    every = counts.withColumn("choice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)))
    digit = F.expr("(choice div below) % n")
    names = ways.select("sample", "region", "way").distinct().withColumn("digit", F.row_number().over(Window.partitionBy("sample", "region").orderBy("way")) - 1)
    return every.withColumn("digit", digit).join(names, ["sample", "region", "digit"]).select("sample", "choice", "region", "way")


def chains(curves: DataFrame, ways: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(sample, choice, chain, place, sid, flipped)`` of each curve in each combination: which curves follow each other, and whether a curve is run through from its end.

    ``curves`` is ``(sample, sid)``; ``ways`` joins end ``a_end`` of ``a`` to end ``b_end`` of ``b`` (0 start, 1 end). No end is joined twice. A chain is named by its free end that comes
    first, where it begins; curves of a loop have no chain (null) and no place.
    """
    joins = ways.join(chosen, ["sample", "region", "way"])
    joins = joins.select("sample", "choice", "a", "a_end", "b", "b_end").union(joins.select("sample", "choice", "b", "b_end", "a", "a_end")).distinct()
    names = curves.select("sample", "sid").distinct()
    most = names.groupBy("sample").count().agg(F.max("count")).first()[0] or 1
    runs = chosen.select("sample", "choice").distinct().join(names, "sample").withColumn("enter", F.explode(F.array(F.lit(0), F.lit(1))))
    ahead = joins.select("sample", "choice", F.col("a").alias("sid"), (1 - F.col("a_end")).alias("enter"), F.struct(F.col("b").alias("sid"), F.col("b_end").alias("enter")).alias("next"))
    here = F.struct("sid", "enter")
    now = runs.join(ahead, ["sample", "choice", "sid", "enter"], "left").select("sample", "choice", here.alias("at"), "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("rank"), F.when(F.col("next").isNull(), here).alias("last"))
    now = stored(now, "runs")
    for _ in range(max(1, (most - 1).bit_length())):
        more = now.select("sample", "choice", F.col("at").alias("next"), F.col("next").alias("then"), F.col("rank").alias("more"), F.col("last").alias("end"))
        # sorted: runs take a few bytes in a file, but a hundred or more in a broadcast
        step = now.join(more.hint("merge"), ["sample", "choice", "next"], "left").select("sample", "choice", "at", F.col("then").alias("next"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"), F.coalesce("last", "end").alias("last"))
        after = stored(step, "runs")
        discard(now)
        now = after
    free = F.struct(F.col("last.sid").alias("sid"), (1 - F.col("last.enter")).alias("end"))
    one = now.select("sample", "choice", F.col("at.sid").alias("sid"), F.col("at.enter").alias("enter"), free.alias("free"), "rank", F.col("last").isNotNull().alias("open"))
    both = one.groupBy("sample", "choice", "sid").agg(F.max("open").alias("open"), F.min(F.struct("free", "enter", "rank")).alias("m"), F.max(F.struct("free", "enter")).alias("x"))
    # where a run ends at the chain's first end, its rank is the place; the curve is entered at the other side
    found = both.select("sample", "choice", "sid", F.when(F.col("open"), F.col("m.free")).alias("chain"), F.when(F.col("open"), F.col("m.rank")).alias("place"), F.when(F.col("open"), F.col("m.enter") == 0).alias("flipped"))
    return stored(found.select("sample", "choice", "chain", "place", "sid", "flipped"), "chains")


def without_loops(found: DataFrame) -> DataFrame:
    """``(sample, choice, strands)`` of the combinations of ``chains`` that close no loop, and how many strands they leave."""
    counts = found.groupBy("sample", "choice").agg(F.count(F.when(F.col("chain").isNull(), 1)).alias("looped"), F.countDistinct("chain").alias("strands"))
    return counts.where("looped = 0").select("sample", "choice", "strands")


def distinct_chains(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(chain_id, sample, path)`` of the different chains, ``path`` their curves in order, and ``(sample, choice, chain_id)``: which combinations have them."""
    path = F.transform(F.sort_array(F.collect_list(F.struct("place", "sid", "flipped"))), lambda x: F.struct(x["sid"].alias("sid"), x["flipped"].alias("flipped")))
    each = stored(found.where("chain is not null").groupBy("sample", "choice", "chain").agg(path.alias("path")).withColumn("same", F.sha2(F.to_json(F.struct("sample", "path")), 256)), "strands")
    # a number, not the digest, goes with every point
    names = numbered(each.select("same", "sample", "path").dropDuplicates(["same"]), "chain_id", "names")
    return names.select("chain_id", "sample", "path"), each.join(names.select("same", "chain_id"), "same").select("sample", "choice", "chain_id")


def assembled(curves: DataFrame, strands: DataFrame, points: int = 16) -> DataFrame:
    """``(sid, k, p*)``: each chain ``(chain_id, path)`` as one curve named by its id, its curves in order with a smooth bridge of ``points`` points, both ends counted, between any two."""
    xyz = [f"p{i}" for i in AXES]
    parts = strands.select("chain_id", F.posexplode("path").alias("place", "c")).select("chain_id", "place", "c.sid", "c.flipped")
    whole = Window.partitionBy("sid")
    rows = parts.join(curves.select("sid", "k", *xyz).withColumn("n", F.count("*").over(whole)).withColumn("last", F.max("k").over(whole)), "sid")
    rows = stored(rows.withColumn("at", F.when(F.col("flipped"), F.col("last") - F.col("k")).otherwise(F.col("k"))).select("chain_id", "place", "n", "at", *xyz), "parts")
    pick = lambda name, where: [F.max(F.when(where, F.col(f"p{i}"))).alias(f"{name}{i}") for i in AXES]
    ends = rows.groupBy("chain_id", "place").agg(*pick("h", F.col("at") == 0), *pick("g", F.col("at") == F.least(F.lit(1), F.col("n") - 1)), *pick("z", F.col("at") == F.col("n") - 1), *pick("y", F.col("at") == F.greatest(F.lit(0), F.col("n") - 2)))
    one = _unit({i: F.col(f"z{i}") - F.col(f"y{i}") for i in AXES})
    two = _unit({i: F.col(f"h{i}") - F.col(f"g{i}") for i in AXES})
    left = ends.select("chain_id", "place", *(F.col(f"z{i}").alias(f"a{i}") for i in AXES), *(one[i].alias(f"s{i}") for i in AXES))
    right = ends.select("chain_id", (F.col("place") - 1).alias("place"), *(F.col(f"h{i}").alias(f"b{i}") for i in AXES), *(two[i].alias(f"t{i}") for i in AXES))
    pairs = left.join(right, ["chain_id", "place"]).withColumn("sid", F.struct("chain_id", "place"))
    bridge = bezier_bridge(pairs, points).where((F.col("k") > 0) & (F.col("k") < points - 1)).select("sid.chain_id", "sid.place", F.lit(1).alias("part"), F.col("k").cast("long").alias("at"), *xyz)
    every = rows.select("chain_id", "place", F.lit(0).alias("part"), F.col("at").cast("long").alias("at"), *xyz).unionByName(bridge)
    number = F.row_number().over(Window.partitionBy("chain_id").orderBy("place", "part", "at")) - 1
    return every.select(F.col("chain_id").alias("sid"), number.cast("long").alias("k"), *xyz)


def solve(curves: DataFrame, ways: DataFrame, most: int = MOST, points: int = 16) -> tuple[DataFrame, DataFrame]:
    """Solutions ``(sample, choice, strands, det, log10_det, is_best)``, the combinations that close no loop, and the combinations ``(sample, choice, region, way)``.

    ``curves`` is ``(sample, sid, k, p*)`` with ids of their own in all samples. Solutions of one strand are scored by the logarithm of their knot's determinant; the
    smallest is the best (ties: the smaller number); samples without such a solution take the first one.
    """
    chosen = stored(combinations(ways, most), "choices")
    found = chains(curves, ways, chosen)
    kept = stored(without_loops(found), "kept")
    strands, having = distinct_chains(found.join(kept.where("strands = 1"), ["sample", "choice"], "left_semi"))
    knots = knot_determinants(assembled(curves, strands, points), strands.select(F.col("chain_id").alias("sid"))).withColumnRenamed("sid", "chain_id")
    scored = kept.join(having, ["sample", "choice"], "left").join(knots, "chain_id", "left")
    order = F.row_number().over(Window.partitionBy("sample").orderBy(F.asc_nulls_last(F.round("log10_det", 9)), "choice"))
    return stored(scored.select("sample", "choice", "strands", "det", "log10_det", (order == 1).alias("is_best")), "solutions"), chosen


def differences(solutions: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(sample, choice, regions)``: the regions in which each solution takes another way than its sample's best, in order; none for the best."""
    best = solutions.where("is_best").join(chosen, ["sample", "choice"]).select("sample", "region", F.col("way").alias("best"))
    rows = solutions.select("sample", "choice").join(chosen, ["sample", "choice"]).join(best, ["sample", "region"])
    return rows.groupBy("sample", "choice").agg(F.sort_array(F.collect_list(F.when(F.col("way") != F.col("best"), F.col("region")))).alias("regions"))
