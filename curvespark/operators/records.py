"""Names, parameters, packed curves and saved states as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvespark.operators.cloud import AXES


def fixed(x: Column, places: int) -> Column:
    """A number with ``places`` decimals as C prints it: the double's exact value is rounded, halves to even, without separators."""
    return F.call_function("format_number", x.cast("double"), F.lit(f"0.{'0' * places}"))


def readable_bytes(n: Column) -> Column:
    """A number of bytes in words: whole below 1,024, else with one decimal in KB to TB."""
    out = F.concat(fixed(n / 1024.0**4, 1), F.lit(" TB"))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024.0 ** (k + 1), F.concat(fixed(n / 1024.0**k, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", F.floor(n))).otherwise(out)


def cloud_name(base: Column, energy: float, linearity: float) -> Column:
    """The name of a cloud cut at two thresholds."""
    return F.concat(base, F.lit(f"_pointcloud_full_energy_{energy:.0f}_linearity_{linearity}.npz"))


def binned_name(name: Column, scale: float) -> Column:
    """A cloud's name with the scale that it was binned at."""
    tag = str(int(scale)) if abs(scale - int(scale)) < 1e-9 else f"{scale:g}"
    return F.concat(F.regexp_replace(name, r"\.npz$", ""), F.lit(f"_ds{tag}.npz"))


def resolved_parameters(inputs: DataFrame, saved: DataFrame, default: dict[str, float], manual: bool = False) -> DataFrame:
    """``inputs`` (sample) with each parameter of ``default`` and ``origin``: as saved for the sample if all of them are, else the default; ``manual`` asks for the default alone."""
    names = list(default)
    found = saved.select("sample", *(F.col(c).alias(f"s_{c}") for c in names)).dropDuplicates(["sample"])
    rows = inputs.join(found, "sample", "left")
    use = F.lit(not manual)
    for c in names:
        use = use & F.col(f"s_{c}").isNotNull()
    origin = F.when(use, "saved").otherwise("manual" if manual else "default")
    return rows.select(*inputs.columns, *(F.when(use, F.col(f"s_{c}")).otherwise(F.lit(default[c])).alias(c) for c in names), origin.alias("origin"))


def batch_parameters(estimates: DataFrame, ratio: float = 1.4) -> DataFrame:
    """``(n, diameter, least, most, sigma, freq, kernel)`` of a batch of estimates ``(sample, diameter)``: from the median of the diameters above zero."""
    d = estimates.where("diameter > 0").agg(F.count("*").alias("n"), F.percentile("diameter", F.lit(0.5)).alias("diameter"), F.min("diameter").alias("least"), F.max("diameter").alias("most")).where("n > 0")
    sigma = F.greatest(F.lit(1), F.bround(F.col("diameter") / 2, 0).cast("int"))
    return d.select("n", "diameter", "least", "most", sigma.alias("sigma"), F.bround(1 / (ratio * F.col("diameter")), 4).alias("freq"), (2 * F.bround(3.0 * sigma, 0).cast("int") + 1).alias("kernel"))


def unpacked(points: DataFrame, offsets: DataFrame, block: int = 4096) -> DataFrame:
    """``(sid, k, ...)``: packed points ``(at, ...)`` as curves; curve ``sid`` holds the places from ``start`` up to ``stop`` of ``offsets (sid, start, stop)``.

    Both sides are cut into blocks of places, which makes the range join an equi-join.
    """
    spans = offsets.where("stop > start").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    rows = points.withColumn("block", F.floor(F.col("at") / block)).join(spans, "block")
    rows = rows.where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop")))
    return rows.select("sid", (F.col("at") - F.col("start")).alias("k"), *(c for c in points.columns if c != "at"))


def packed_offsets(curves: DataFrame) -> DataFrame:
    """``(sid, start, stop)`` of curves packed one after the other in the order of their numbers: a row a curve."""
    n = curves.groupBy("sid").agg(F.count("*").alias("n"))
    # running sums within ranges of curves, and over the ranges: no task orders all curves
    parts = n.withColumn("part", F.floor(F.col("sid") / 4096))
    sums = parts.groupBy("part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("n").over(Window.partitionBy("part").orderBy("sid"))
    return parts.join(sums.select("part", before.alias("before")), "part").select("sid", (F.col("before") + own - F.col("n")).alias("start"), (F.col("before") + own).alias("stop"))


def longest_curve(curves: DataFrame, group: str, named: DataFrame | None = None) -> DataFrame:
    """``(group, sid, n)``: the curve that ``named (group, sid)`` asks for, or the one of the most points (ties: the smaller number)."""
    sizes = curves.groupBy(group, "sid").agg(F.count("*").alias("n"))
    wanted = F.lit(False)
    if named is not None:
        sizes = sizes.join(named.select(group, "sid", F.lit(True).alias("wanted")).distinct(), [group, "sid"], "left")
        wanted = F.coalesce("wanted", F.lit(False))
    best = F.max(F.struct(wanted.alias("wanted"), "n", (-F.col("sid")).alias("m"))).alias("b")
    return sizes.groupBy(group).agg(best).select(group, (-F.col("b.m")).alias("sid"), "b.n")


def strand_lines(curves: DataFrame, radius: float) -> DataFrame:
    """``(sid, place, line)``: curves as lines of place and radius, an empty line after each; curves of one point have none."""
    rows = curves.withColumn("n", F.count("*").over(Window.partitionBy("sid"))).where("n > 1")
    lines = rows.select("sid", F.col("k").alias("place"), F.concat_ws(" ", *(fixed(F.col(f"p{k}"), 4) for k in AXES), F.lit(f"{radius:.4f}")).alias("line"))
    return lines.union(rows.select("sid", F.col("n").alias("place"), F.lit("").alias("line")).distinct())


def save_version(tables: dict[str, DataFrame], path: str, tag: str, at: str) -> None:
    """Write the tables of one version below ``path``, each as Parquet in ``name/tag=.../at=...``; older versions stay."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/tag={tag}/at={at}")


def load_version(spark: SparkSession, path: str, name: str, tags: list[str]) -> DataFrame | None:
    """The newest version of a table with the first of ``tags`` that has one; None if there is none."""
    root = f"{path.rstrip('/')}/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.option("recursiveFileLookup", "false").option("basePath", root).parquet(root).withColumn("at", F.col("at").cast("string"))
    for tag in tags:
        found = rows.where(F.col("tag") == tag)
        newest = found.agg(F.max("at").alias("at")).first()["at"]
        if newest is not None:
            return found.where(F.col("at") == newest).drop("tag", "at")
    return None


def obj_numbered(curves: DataFrame) -> DataFrame:
    """``(part, at, line)``: all curves as one OBJ file, vertices first and then a polyline for each curve, whose vertices are numbered through the file."""
    starts = packed_offsets(curves)
    vertex = F.concat_ws(" ", F.lit("v"), *(fixed(F.col(f"p{k}"), 6) for k in AXES))
    points = curves.join(starts, "sid").select(F.lit(0).alias("part"), (F.col("start") + F.col("k")).alias("at"), vertex.alias("line"))
    lines = starts.where("stop > start + 1").select(F.lit(1), F.col("start"), F.concat(F.lit("l "), F.array_join(F.sequence(F.col("start") + 1, F.col("stop")), " ")))
    return points.union(lines)
