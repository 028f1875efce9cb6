"""The corpus pipeline: score, clean, deduplicate, decontaminate and tokenise the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowmill.llm import bpe, decontaminate, line_dedup, minhash, quality
from flowmill.llm.common import table
from flowmill.llm.queries import MIN_SCORE, byte_vocabulary
from flowmill.session import scratch_path, tune


def _like(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """`kept` with the columns of `docs`, in their order."""
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality.classify(docs.withColumnRenamed("score", "given_score"), table(spark, sf_dir, "labels"))
    good = scored.where(F.col("score") >= MIN_SCORE).drop("score").withColumnRenamed("given_score", "score")
    return _like(good, docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many share; n_chars counts what is left."""
    cleaned = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _like(cleaned, docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _like(minhash.drop_near_duplicates(docs), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _like(decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return bpe.digests(docs, byte_vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_shared_lines),
    ("MinHash near-dedup", drop_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenise),
]

# SQL expresses neither the classifier nor the merges; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's rows written once and read by the next."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
