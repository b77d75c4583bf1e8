"""Shards that all have the corpus's mixture: proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle; the rank as a share of the source says where a row stands in the whole
corpus, so sources are spread evenly over it; the sequence is cut into shards whose counts differ by one at most.

Ranks need no task that holds a whole source: rows are dealt out by ranges of their order, numbered within their range, and add the number of rows in the ranges before
theirs. Ranges follow the rows, so a source with a third of all rows, or a fraction that all sources of one row share, is spread like everything else.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvespark.plans.lineage import discard, new_folder, stored


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` stored, with their number from 0 in the order of the columns."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    total, before = 0, []
    for part, n in sorted(placed.groupBy("__part").count().collect()):  # a row for each partition of the shuffle
        before.append({"__part": part, "__before": total})
        total += n
    counts = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(before)), "array<struct<__part: int, __before: bigint>>")))
    out = placed.join(F.broadcast(counts), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
    out._stored_at = placed._stored_at
    return out


def shard_rows(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for each row; ``size`` is the text's UTF-8 bytes plus one, ``slot`` the row's place in its shard.

    Null texts have size 1 and the CRC-32 of no bytes; a null source is a source of its own; null ids shuffle as an empty text. Repeated ids are
    ordered by CRC-32 and size; rows alike in all of these are interchangeable. An empty table has no shards.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    source = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.to_json(source).alias("source"), shuffled.alias("hash"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = stored(rows, "rows")  # numbers and hashes, without the texts
    by = ["hash", "doc_id", "text_crc32", "size"]
    ordered = _numbered(rows, ["source", *by], "number")
    # sources are runs of the order: a row's rank is its number less that of its source's first row
    sources = ordered.groupBy("source").agg(F.count("*").alias("of"), F.min("number").alias("first"))
    ranked = ordered.join(sources, "source").withColumn("share", (2 * (F.col("number") - F.col("first")) + 1) / (2 * F.col("of")))
    ranked = stored(ranked.drop("number", "first", "of"), "ranked")
    placed = _numbered(ranked, ["share", "source", *by], "place")
    total = rows.count()
    discard(ordered, ranked)
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, folder: str | None = None, shards: int = 8, seed: int = 0, id_col: str = "doc_id", **columns: str) -> str:
    """Write ``docs``, whose ids are distinct and not null, as one folder of Parquet files a shard; returns the folder."""
    placed = shard_rows(docs, shards, seed, id_col, **columns).select(F.col("doc_id").alias(id_col), "shard", "slot")
    folder = folder or new_folder(docs.sparkSession, "shards")
    clear = [c for c in docs.columns if c not in ("shard", "slot")]
    docs.select(*clear).join(placed, id_col).write.partitionBy("shard").parquet(folder)
    return folder
