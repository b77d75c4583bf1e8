"""Choosing inputs and totalling runs: manifests and run logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def priority_order(files: DataFrame, keywords: list[str], name: str = "name") -> DataFrame:
    """``bucket``: the place of the first keyword that the name holds, in any case; names without one come last. ``place`` numbers files by bucket and name."""
    bucket = F.lit(len(keywords))
    for k, word in reversed(list(enumerate(keywords))):
        bucket = F.when(F.lower(name).contains(word.lower()), k).otherwise(bucket)
    out = files.withColumn("bucket", bucket)
    # numbering needs an order over all names: buckets first, so that each is ranked apart
    sizes = out.groupBy("bucket").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a bucket
    sizes = sizes.select("bucket", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(name, "id"))
    return out.withColumn("rank", rank).join(F.broadcast(sizes), "bucket").withColumn("place", F.col("before") + F.col("rank")).drop("before", "rank")


def prefer(files: DataFrame, first: str, second: str, name: str = "name") -> DataFrame:
    """One file for each stem (the name before ``_pointcloud_``): the one of the first kind if there is one, then of the second, then by name."""
    stem = F.substring_index(name, "_pointcloud_", 1)
    kind = F.when(F.col(name).endswith(first), 0).when(F.col(name).endswith(second), 1).otherwise(2)
    best = F.min(F.struct(kind.alias("kind"), F.col(name).alias("name"), F.col("id").alias("id")))
    return files.groupBy(stem.alias("stem")).agg(best.alias("b")).select("stem", "b.name", "b.id")


def wanted_and_missing(files: DataFrame, wanted: DataFrame, key: str = "sample") -> DataFrame:
    """``(sample, found, n)`` for each name asked for."""
    n = files.groupBy(key).agg(F.count("*").alias("n"))
    out = wanted.select(key).distinct().join(n, key, "left")
    return out.select(key, F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("n"))


def pending(files: DataFrame, done: DataFrame, key: str = "sample") -> DataFrame:
    """Files whose key has no output yet."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def run_totals(log: DataFrame) -> DataFrame:
    """``(stage, status, runs, bytes, share)`` with each status's share of its stage's runs."""
    each = log.groupBy("stage", "status").agg(F.count("*").alias("runs"), F.sum("bytes").alias("bytes"))
    return each.withColumn("share", F.col("runs") / F.sum("runs").over(Window.partitionBy("stage")))


def newest(versions: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key (ties: the largest row)."""
    others = [c for c in versions.columns if c != key]
    top = versions.groupBy(key).agg(F.max(F.struct(at, *(c for c in others if c != at))).alias("r"))
    return top.select(key, *(F.col(f"r.{c}").alias(c) for c in others))
