"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a new one for a local session, and an error on a cluster, whose machines share no such folder."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and context.getCheckpointDir().isDefined():
        folder = context.getCheckpointDir().get()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="curvespark-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later uses don't compute it again, lost executors don't matter."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` returned and nothing will read again; anything else is left alone."""
    for table in tables:
        if table is not None and (path := getattr(table, "_stored_at", None)):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, column: str, name: str = "rows") -> DataFrame:
    """``df`` stored with a number of its own for each row, so that every later scan sees the same numbers, however it is split."""
    return stored(df.withColumn(column, F.monotonically_increasing_id()), name)


def ordered(df: DataFrame, order: list[str], column: str, name: str = "ordered") -> DataFrame:
    """``df`` stored with the number of each row in the order of the columns, from 0: ranges of the order are numbered each, and the counts of those before are added. No task holds more than a range."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    total, before = 0, []
    for part, n in sorted(placed.groupBy("__part").count().collect()):  # a row for each partition of the shuffle
        before.append({"__part": part, "__before": total})
        total += n
    counts = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(before)), "array<struct<__part: int, __before: bigint>>")))
    out = placed.join(F.broadcast(counts), "__part").withColumn(column, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
    out._stored_at = placed._stored_at
    return out
