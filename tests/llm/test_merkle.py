"""Manifests, proofs and the recursive climb against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from curvespark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    parts = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain(rows):
    """Every leaf's way up, one node at a time."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names]) if names else [[None]]
    out = []
    for g, s in enumerate(names):
        for k, r in enumerate(groups[s]):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now, siblings = leaf(r, text), ""
            for levels, i in ((trees[s], k), (top, g)):
                for level in levels[:-1]:
                    first = i - i % 3
                    before, after = "".join(level[first:i]), "".join(level[i + 1 : first + 3])
                    now, siblings, i = sha(before + now + after), siblings + before + after, i // 3
            out.append((r["doc_id"], trees[s][0][k], trees[s][-1][0], top[-1][0], sha(siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


CASES = {
    "empty": [],
    "one row": [(1, "a\nb", None, "s", 3)],
    "nulls, repeats and lone sources": [(1, "a\nb", "en", None, 3), (1, "a\nb", "en", None, 3), (None, "x\n", None, None, None), (2, None, "de", "ü", 1), (4, "x\ny", "de", "z", 1), (5, "", "", "", 0)],
    "one source of ten": [(k, f"t\n{k}" * k, "en", "s", k) for k in range(10)],
    "sources of one row": [(k, f"t\n{k}", "en", f"s{k}", k) for k in range(30)],
    "a third in one source, long texts": [(7 * k % 101, "line\n" * (k if k % 10 else 40_000), "en", "hot" if k % 3 == 0 else f"s{k % 7}", k) for k in range(100)],
}


@pytest.mark.parametrize("name", CASES)
def test_digests_equal_plain_ones(spark, name):
    docs = spark.createDataFrame(CASES[name], SCHEMA)
    assert sorted(map(tuple, merkle.digests(docs).collect()), key=str) == plain([r.asDict() for r in docs.collect()])


def test_several_rounds_of_blocks(spark):
    """5,000 leaves in a source: blocks of 2,187 leaves and a round above them; other columns with clashing names are not read."""
    docs = spark.range(5400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t\n"), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 5000, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("source"), F.lit(3).cast("long").alias("n_chars"))
    extra = docs.withColumns({c: F.lit(1) for c in ("node", "block", "leaf", "number", "hash", "__part", "root", "tree", "now")})
    assert sorted(map(tuple, merkle.digests(extra).collect()), key=str) == plain([r.asDict() for r in docs.collect()])


def test_proofs_fold_to_the_root_unless_a_leaf_changes(spark):
    rows = spark.range(700).select((F.col("id") % 3).cast("string").alias("part"), "id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    built = merkle.build_manifest(rows, "part", "id", "leaf", ("id",))
    folded = merkle.climb(built).join(built.leaves, "number")
    assert folded.where(F.col("folded") == F.lit(bytearray(built.root))).count() == 700
    built.leaves = built.leaves.withColumn("wrong", F.when(F.col("id") == 5, F.unhex(F.sha2(F.lit("x"), 256))).otherwise(F.col("leaf")))
    folded = merkle.climb(built, "wrong").join(built.leaves, "number")
    assert [r.id for r in folded.where(F.col("folded") != F.lit(bytearray(built.root))).collect()] == [5]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"
    most = built.nodes.groupBy("block").count().agg(F.max("count")).first()[0]
    assert most <= 2 * merkle.BLOCK
