"""Engine tables (clouds, volumes, curves, logs) made from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _hours(ts: str) -> F.Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts})") / F.lit(3.6e9)


def cloud_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """An oriented cloud: time, value and user as position, a direction from the event's number."""
    k = F.get_json_object("props", "$.k").cast("double")
    angle = 2 * F.pi() * k / 100
    return read(spark, folder, "events").select(
        F.col("event_id").alias("id"), _hours("ts").alias("p0"), F.col("value").alias("p1"), F.col("user_id").cast("double").alias("p2"),
        F.cos(angle).alias("d0"), F.sin(angle).alias("d1"), F.lit(0.0).alias("d2"), F.col("value").alias("energy"), (k / 100).alias("linearity"),
    )


def cloud_from_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """An oriented cloud from the first ten components of the vectors; directions are not of length one."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), *(e(i).alias(f"p{i}") for i in range(3)), *(e(i + 3).alias(f"d{i}") for i in range(3)),
        F.sqrt(e(6) * e(6) + e(7) * e(7) + e(8) * e(8)).alias("energy"), F.abs(e(9)).alias("linearity"),
    )


def volume_from_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A sparse volume: a voxel for each line number, quantity and discount, its value the mean price."""
    keys = [F.col("l_returnflag").alias("sample"), F.col("l_linenumber").cast("int").alias("z"), F.round("l_quantity").cast("int").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x")]
    return read(spark, folder, "lineitem").groupBy(*keys).agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))


def curves_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """A polyline for each user: its events in order of time."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = read(spark, folder, "events").select(F.col("user_id").alias("sid"), "ts", "event_id", _hours("ts").alias("p0"), F.col("value").alias("p1"), (k / 100).alias("p2"))
    order = F.row_number().over(_by_sid().orderBy("ts", "event_id")) - 1
    return rows.select("sid", order.cast("long").alias("k"), "p0", "p1", "p2")


def signal_from_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A signal for each supplier: its prices in order of shipping."""
    order = F.row_number().over(_by_sid().orderBy("l_shipdate", "l_orderkey", "l_linenumber")) - 1
    rows = read(spark, folder, "lineitem").withColumn("sid", F.col("l_suppkey"))
    return rows.select("sid", order.cast("long").alias("k"), F.col("l_extendedprice").alias("x"))


def repair_log(spark: SparkSession, folder: str) -> DataFrame:
    """A log of edits from the events."""
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, folder, "events").select("ts", F.col("user_id").alias("sid"), F.when(F.col("event_type") == "click", "B").otherwise("A").alias("kind"), F.col("event_id").alias("g1"), k.alias("n_synth"))


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("bytes"), F.col("o_custkey").alias("sample"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "full").otherwise("sub")
    return read(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("_pointcloud_"), kind).alias("name"), F.col("p_retailprice").alias("bytes"))


def _by_sid():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("sid")
