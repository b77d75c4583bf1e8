"""A corpus pipeline: toxic documents out, one of each group of near-duplicates, benchmark passages out, secrets masked, texts encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespark.llm import bpe, decontamination, secrets, simhash, toxicity
from curvespark.llm.queries import tokenizer
from curvespark.plans.lineage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score below the threshold. Rows, columns and texts stay as they are; null texts stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()))
    scored = toxicity.with_scores(docs, model, score_col="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group. Null and empty texts are a group of their own."""
    return simhash.keep_one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make less than a twentieth."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, and ``n_chars`` counted anew where the text changed."""
    masked = secrets.redact_secrets(docs.withColumn("__before", F.length("text")))
    changed = F.length("text") != F.col("__before")
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of each document: its token ids, and the text that they decode to (null texts: no ids, an empty text)."""
    model = tokenizer()
    encoded = bpe.encode(docs.select("doc_id", "text"), model).select("doc_id", "ids")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.decode(F.col("ids"), model).cast("string").alias("decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", encode_and_decode),
]

#: The learned stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
