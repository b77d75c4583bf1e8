"""A Merkle manifest of a dataset, and proofs folded by a recursive query.

Rows are leaves; within a source they stand in the order of their ids, and every ``RUN`` neighbours have a parent, until one node is left, the
source's root; the sources' roots, in the order of their names, are the leaves of the tree above. The built levels are stored as node rows that name
their parent and hold their siblings' digests. A recursive query then lets each leaf climb: a step joins the node it stands on, folds the siblings
around its digest and goes on to the parent.

Nothing meets in one task. Leaves are numbered by range partitions and their counts. Levels are built in blocks of ``BLOCK`` leaves, seven levels at a
time, which each fit into a row. A high node, below which a third of all rows may lie, is stored once for each block of leaves below it, and a leaf
joins the copy of its own block: no join key has more than ``BLOCK`` rows, and copies are as many as blocks times levels.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespark.plans.lineage import discard, stored

#: So many consecutive nodes have one parent.
RUN = 3
BLOCK_LEVELS = 7
BLOCK = RUN**BLOCK_LEVELS
#: A node's number is its level times ``PLACES`` plus the number of the first leaf below it; the tree of sources begins at level ``TOP``.
PLACES = 1 << 48
TOP = 64
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass
class Manifest:
    """``leaves`` (number, block, node, leaf and the columns kept), ``nodes`` (block, node, parent, before, after), ``roots`` (block, tree, subroot) and the root; digests are binary."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    root: bytes | None

    def discard(self) -> None:
        discard(self.leaves, self.nodes)


def field(column: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its UTF-8 bytes' count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def _digest(*parts: Column) -> Column:
    """The digest of digests, concatenated as lowercase hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(F.concat(*parts))), 256))


def _in_order(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` stored in order with ``__part`` and ``__at`` (the place in it), and ``(__part, __offset)``: a row's number is the sum of both."""
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stored(placed, name)
    total, offsets = 0, []
    for part, n in sorted(placed.groupBy("__part").count().collect()):  # a row for each partition of the shuffle
        offsets.append({"__part": part, "__offset": total})
        total += n
    table = F.from_json(F.lit(json.dumps(offsets)), "array<struct<__part: int, __offset: bigint>>")
    return placed, rows.sparkSession.range(1).select(F.inline(table))


def _levels(entries: DataFrame) -> DataFrame:
    """``(tree, of, block, levels)``: the entries (tree, at, of, hash, first, last) of each block, and up to seven levels above them, as long as their tree has several nodes.

    The last block of a tree may be short; its nodes without neighbours get parents like all others.
    """
    n = sum(((F.col("of") > RUN**k).cast("int") for k in range(BLOCK_LEVELS)), F.lit(0))
    gathered = entries.groupBy("tree", "of", F.expr(f"at div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "hash", "first", "last"))).alias("own"))

    def above(a: Column) -> Column:
        def parent(i: Column) -> Column:
            three = [F.get(a, i * RUN + k) for k in range(RUN)]
            last = F.coalesce(*(x["last"] for x in reversed(three)))
            empty = F.lit("").cast("binary")
            return F.struct(i.cast("long").alias("at"), _digest(*(F.coalesce(x["hash"], empty) for x in three)).alias("hash"), three[0]["first"].alias("first"), last.alias("last"))

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), parent)

    grown = F.aggregate(F.sequence(F.lit(1), n), F.array("own"), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))
    return gathered.select("tree", "of", "block", F.when(n > 0, grown).otherwise(F.array("own")).alias("levels"))


def _node_rows(levels: DataFrame, base: int, below: bool) -> DataFrame:
    """``(first, last, node, parent, before, after)`` of all nodes but each block's top; ``below``: the tree's root is a leaf of the tree of sources."""
    rows = levels.select("of", F.posexplode(F.slice("levels", F.lit(1), F.size("levels") - 1)).alias("level", "nodes"))
    rows = rows.select("of", "level", "nodes", F.posexplode("nodes").alias("i", "own"))
    start = F.col("i") - F.col("i") % RUN
    beside = [F.get("nodes", start + k) for k in range(RUN)]
    empty = F.lit("").cast("binary")
    when = lambda test, x: F.when(test, F.coalesce(x["hash"], empty)).otherwise(empty)
    step = F.col("i") % RUN
    parent_level = F.col("level") + F.lit(base + 1)
    if below:
        topped = F.col("of") <= F.element_at(F.array(*(F.lit(RUN ** (k + 1)) for k in range(BLOCK_LEVELS))), F.col("level") + 1)
        parent_level = F.when(topped, F.lit(TOP)).otherwise(parent_level)
    return rows.select(
        F.col("own.first").alias("first"),
        F.col("own.last").alias("last"),
        ((F.col("level") + F.lit(base)).cast("long") * PLACES + F.col("own.first")).alias("node"),
        (parent_level.cast("long") * PLACES + beside[0]["first"]).alias("parent"),
        F.concat(*(when(step > k, beside[k]) for k in range(RUN))).alias("before"),
        F.concat(*(when(step < k, beside[k]) for k in range(RUN))).alias("after"),
    )


def _build(entries: DataFrame, most: int, base: int, below: bool) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """The node rows of all trees, ``(tree, first, last, hash)`` of their roots, and the stored tables that both read; ``most``: leaves of the largest tree."""
    nodes, roots, kept = [], [entries.where("of = 1").select("tree", "first", "last", "hash")], []
    entries = entries.where("of > 1")
    while most > 1:
        levels = stored(_levels(entries), "levels")
        kept.append(levels)
        nodes.append(_node_rows(levels, base, below))
        top = F.element_at(F.element_at("levels", -1), 1)
        up = levels.select("tree", F.col("block").alias("at"), F.expr(f"(of + {BLOCK - 1}) div {BLOCK}").alias("of"), top["hash"].alias("hash"), top["first"].alias("first"), top["last"].alias("last"))
        roots.append(up.where("of = 1").select("tree", "first", "last", "hash"))
        entries, most, base = up.where("of > 1"), -(-most // BLOCK), base + BLOCK_LEVELS
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return nodes, found, kept


def build_manifest(rows: DataFrame, source_col: str, order_col: str, leaf_col: str, keep: tuple[str, ...] = ()) -> Manifest:
    """The manifest of ``rows``, which have a binary digest in ``leaf_col``; ``keep``: further columns that the leaves carry.

    Within a source, leaves ascend by ``order_col``, null first, equal values by their digests; sources ascend by UTF-8 bytes, null first. Rows alike in
    all three are leaves of their own. An empty table has no leaves and no root. Columns are renamed inside, so none can clash.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(source_col).cast("string").alias("__source"), F.col(order_col).alias("__order"), F.col(leaf_col).alias("__leaf"), *(F.col(c).alias(f"__keep_{k}") for k, c in enumerate(keep)))
    raw = stored(named, "digests")  # the range partitioner samples what it deals out
    placed, offsets = _in_order(raw, ["__source", "__order", "__leaf"], "ordered")
    pieces = placed.groupBy("__part", "__source").agg(F.count("*").alias("n"), F.min("__at").alias("at")).join(F.broadcast(offsets), "__part")
    pieces = pieces.select("__part", F.col("__source").alias("s"), "n", (F.col("at") + F.col("__offset")).alias("start"), "__offset")
    sources = pieces.groupBy("s").agg(F.min("start").alias("tree"), F.sum("n").alias("of"))
    spans = pieces.select("__part", "s", "__offset").join(sources.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t"))).withColumnRenamed("__part", "p")
    leaves = placed.join(spans, (F.col("__part") == F.col("p")) & F.col("__source").eqNullSafe(F.col("s")))
    number = (F.col("__at") + F.col("__offset")).alias("number")
    leaves = leaves.select(number, "tree", "of", F.col("__leaf").alias("leaf"), *(F.col(f"__keep_{k}").alias(c) for k, c in enumerate(keep)))
    leaves = leaves.withColumn("block", F.expr(f"number div {BLOCK}")).withColumn("node", F.when(F.col("of") == 1, F.lit(TOP)).otherwise(F.lit(0)).cast("long") * PLACES + F.col("number"))
    leaves = stored(leaves, "leaves")
    most = leaves.agg(F.max("of")).first()[0] or 0
    discard(raw, placed)
    entries = leaves.select("tree", (F.col("number") - F.col("tree")).alias("at"), "of", F.col("leaf").alias("hash"), F.col("number").alias("first"), F.col("number").alias("last"))
    nodes, subroots, kept = _build(entries, most, 0, True)
    ranked, offsets = _in_order(subroots, ["first"], "ranked")
    count = ranked.count()
    above = ranked.join(F.broadcast(offsets), "__part").select(F.lit(-1).cast("long").alias("tree"), (F.col("__at") + F.col("__offset")).alias("at"), F.lit(count).cast("long").alias("of"), "hash", "first", "last")
    upper, root, more = _build(above, count, TOP, False)
    blocks = F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}"))).alias("block")
    tables = [x.select(blocks, "node", "parent", "before", "after") for x in (*nodes, *upper)]
    if tables:
        every = tables[0]
        for x in tables[1:]:
            every = every.unionByName(x)
    else:
        every = spark.createDataFrame([], "block long, node long, parent long, before binary, after binary")
    every = stored(every, "nodes")
    top = root.select("hash").first()
    discard(*kept, *more)
    return Manifest(leaves, every, ranked.select(blocks, "tree", F.col("hash").alias("subroot")), bytes(top[0]) if top else None)


_CLIMB = """
WITH RECURSIVE climb (number, block, step, siblings, hash, node) AS (
  SELECT a.number, a.block, 0, coalesce(concat(b.before, b.after), X''), if(b.node IS NULL, a.hash, unhex(sha2(lower(hex(concat(b.before, a.hash, b.after))), 256))), coalesce(b.parent, a.node)
  FROM {leaves} a LEFT JOIN {lowest} b ON a.block = b.block AND a.node = b.node
  UNION ALL
  SELECT c.number, c.block, c.step + 1, concat(n.before, n.after), unhex(sha2(lower(hex(concat(n.before, c.hash, n.after))), 256)), n.parent
  FROM climb c JOIN {higher} n ON c.block = n.block AND c.node = n.node
)
SELECT number, max_by(hash, step) AS folded, sort_array(collect_list(struct(step, siblings))) AS path FROM climb GROUP BY number
"""


def climb(manifest: Manifest, hash_col: str = "leaf") -> DataFrame:
    """``(number, folded, siblings)`` for each leaf: the root that its digest in ``hash_col`` folds to, and its siblings' digests from below to above, concatenated.

    Each step adds a row with its siblings instead of lengthening them, so a leaf moves a digest and two siblings a step. The session's limit of rows of a
    recursion is lifted for the run and set back.
    """
    spark = manifest.leaves.sparkSession
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        leaves = manifest.leaves.select("number", "block", "node", F.col(hash_col).alias("hash"))
        found = spark.sql(_CLIMB, leaves=leaves, lowest=manifest.nodes.where(F.col("node") < PLACES), higher=manifest.nodes.where(F.col("node") >= PLACES))
        joined = F.aggregate("path", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["siblings"]))
        return stored(found.select("number", "folded", joined.alias("siblings")), "climbed")
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def document_proofs(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, siblings, folded, tampered)`` of each row of ``docs``: digests are binary, ``folded`` is the root that the row folds to after tampering.

    Where two divides the CRC-32 of the decimal id, tampering deletes the text's line ends; other rows, null ids and null texts stay as they are.
    Repeated rows are leaves of their own; other columns aren't read; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))
    digest = lambda t: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)
    rows = docs.select("doc_id", "source", digest(text).alias("leaf"), F.when(hit, digest(F.replace(text, F.lit("\n"), F.lit("")))).alias("other"))
    rows = rows.withColumn("now", F.coalesce("other", "leaf")).withColumn("tampered", F.col("other").isNotNull())
    manifest = build_manifest(rows, "source", "doc_id", "leaf", ("doc_id", "now", "tampered"))
    climbed = climb(manifest, "now")
    out = manifest.leaves.join(manifest.roots, ["block", "tree"]).join(climbed, "number")
    root = F.lit(bytearray(manifest.root) if manifest.root else None).cast("binary")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "siblings", "folded", "tampered")


def digests(docs: DataFrame) -> DataFrame:
    """``document_proofs`` as lowercase hexadecimal text, the siblings as one digest, and whether what was folded is the root."""
    text = lambda c: F.lower(F.hex(c)).alias(c)
    proof = F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256")
    return document_proofs(docs).select("doc_id", text("leaf"), text("subroot"), text("root"), proof, F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
