"""SimHash fingerprints and near-duplicate groups by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespark.operators.components import connected_components
from curvespark.plans.lineage import numbered, stored

SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Three segments for four differing bits: one of them differs by one bit at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Above so many distinct fingerprints, a variant also carries one of five pieces of the other segments, one of which is equal.
REFINE_ABOVE = 8_000_000
#: Places in which a large group's fingerprints meet what its group is called.
SALTS = 16
#: A hint for joins on tables that grow with the fingerprints: Spark takes the size of variants for that of what they are made of, a 64th, and would broadcast them.
SORTED = "merge"
_CHUNK = 1 << 16


def simhash(text: str | None) -> int:
    """The fingerprint as an unsigned 64-bit number: A-Z lower-cased, words between ASCII white space, shingles of
    four words (of all words if fewer), XXH64 with seed 42, a bit set if in over half of the hashes. Null or no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    first, last = starts[:n].tolist(), (ends[min(SHINGLE_WORDS, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):  # bounded memory for very long texts
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + _CHUNK], last[k : k + _CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = np.fromiter((simhash(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keys: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs``' key columns, named as in ``keys`` (new name: column), and ``fp``, the fingerprint as a signed long."""
    wanted = docs.select(*(F.col(c).alias(k) for k, c in keys.items()), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    return wanted.mapInArrow(_fingerprint_batches, f"{schema}, fp long")


def _part(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _variants(prints: DataFrame, refine: bool) -> DataFrame:
    """A row for each one-wildcard variant of each segment: ``key`` is the segment, the wildcard's place and the other bits."""
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "fp")  # a small table makes many rows
    parts = []
    for s, (at, width) in enumerate(SEGMENTS):
        for bit in range(width):
            masked = _part(F.col("fp"), at, width).bitwiseAND(F.lit((1 << width) - 1 - (1 << bit)))
            parts.append((masked * 64 + bit) * 4 + s)
    out = prints.withColumn("key", F.explode(F.array(*parts)))
    if refine:
        # The other 42 or 43 bits, in five pieces: with four differing bits at most, one piece is equal.
        segment = F.col("key").bitwiseAND(F.lit(3))
        pieces = []
        for s, (at, width) in enumerate(SEGMENTS):
            low = _part(F.col("fp"), 0, at) if at else F.lit(0).cast("long")
            rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", at + width), at)) if at + width < 64 else low
            pieces.append(F.array(*(_part(rest, 9 * k, 9) * 8 + k for k in range(5))))
        chosen = F.when(segment == 0, pieces[0]).when(segment == 1, pieces[1]).otherwise(pieces[2])
        out = out.withColumn("piece", F.explode(chosen)).withColumn("key", F.col("key") * 4096 + F.col("piece")).drop("piece")
    return out


def _first_shared(xor: Column, key: Column) -> Column:
    """Whether ``key`` is the first of the variants that two fingerprints with this difference share."""
    first = F.lit(-1).cast("long")
    for s, (at, width) in reversed(list(enumerate(SEGMENTS))):
        part = _part(xor, at, width)
        place = F.bit_count(part - 1)  # of a part with one bit: its place
        first = F.when(part == 0, F.lit(s)).when(F.bit_count(part) == 1, place * 4 + s).otherwise(first)
    return key.bitwiseAND(F.lit(255)) == first


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """``(fp, component)`` for distinct ``fp``: groups of fingerprints joined by chains of links (four differing bits at most).

    First every fingerprint of a variant's bucket is tried against the bucket's smallest one, which joins dense
    groups by as many links as they have members. Then the self-join on variants compares the pairs of each bucket and
    returns those close pairs that no chain joins yet, so a group of thousands doesn't return all its pairs.
    """
    prints = stored(prints.select("fp").distinct(), "prints")
    refine = prints.count() > REFINE_ABOVE
    buckets = _variants(prints, refine)
    least = buckets.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w").drop("w")
    stars = buckets.join(least.hint(SORTED), "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)
    stars = stored(stars.where("fp <> v").select(F.col("fp").alias("u"), "v").distinct(), "stars")
    joined = connected_components(stars)
    named = prints.join(joined.withColumnRenamed("node", "fp").hint(SORTED), "fp", "left")
    named = stored(named.select("fp", F.coalesce("component", "fp").alias("c")), "named")
    buckets = _variants(named, refine)
    a, b = buckets.select("key", F.col("fp").alias("u"), F.col("c").alias("cu")), buckets.select("key", F.col("fp").alias("v"), F.col("c").alias("cv")).hint(SORTED)
    xor = F.col("u").bitwiseXOR(F.col("v"))
    close = (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & (F.bit_count(xor) <= MAX_DISTANCE)
    if refine:
        found = a.join(b, (a["key"] == b["key"]) & close)
    else:
        found = a.join(b, (a["key"] == b["key"]) & close & _first_shared(xor, a["key"]))
    merged = connected_components(found.select("cu", "cv"), "cu", "cv")
    out = named.join(merged.withColumnRenamed("node", "c").hint(SORTED), "c", "left")
    return stored(out.select("fp", F.coalesce("component", "c").alias("component")), "linked")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row: 16 lowercase hex digits, and the smallest id of its group.

    Null texts and texts without words have fingerprint zero and form a group like any other. Repeated rows are each returned.
    Null ids are returned with the smallest id of their group (null if it has none). Other columns of ``docs`` are not read.
    """
    prints = stored(fingerprints(docs, {"doc_id": id_col}, text_col), "fingerprints")
    groups = link_fingerprints(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(groups.hint(SORTED), "fp")
    smallest = stored(least.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    # a group's other fingerprints, maybe a third of all, meet its smallest id in several places
    alone = least.where("fp = component").join(smallest.hint(SORTED), "component").select("fp", "component_id")
    spread = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = least.where("fp <> component").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    names = alone.union(others.join(spread.hint(SORTED), ["component", "salt"]).select("fp", "component_id"))
    return prints.join(names.hint(SORTED), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate group: the one with the smallest id.

    Rows are numbered once and stored, so repeated ids and null ids (last in order) lose no group.
    """
    placed = numbered(docs, "__row", "documents")
    prints = stored(fingerprints(placed, {"__row": "__row", "doc_id": id_col}, text_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("first")
    least = prints.groupBy("fp").agg(first).join(link_fingerprints(prints).hint(SORTED), "fp")
    kept = least.groupBy("component").agg(F.min("first").alias("first")).select("first.__row")
    return placed.join(kept, "__row", "left_semi").select(*docs.columns)
