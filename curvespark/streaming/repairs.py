"""The edit log as a stream: work sessions closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts string, sample string, sid long, kind string, g1 long, g2 long, n_synth long"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines as they are appended."""
    return spark.readStream.schema(SCHEMA).json(folder)


def live_sessions(log: DataFrame, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(sid, start, end, edits, connects, synthetic)``: windows that end ``idle`` after a session's last edit; works on streams and on tables alike."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    found = timed.groupBy("sid", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("edits"), F.sum(F.when(F.col("kind") == "B", 1).otherwise(0)).alias("connects"), F.sum("n_synth").alias("synthetic"))
    return found.select("sid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "edits", "connects", "synthetic")
