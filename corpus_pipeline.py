"""Documents to training tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import decontaminate, jaccard, line_dedup, quality, sentence_pieces, simhash
from holdfast.llm._arrow import ensure_checkpoint_dir, read_table, remove


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; ``n_chars`` follows the text."""
    kept = line_dedup.drop_shared_lines(docs, counts=False)
    return kept.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.keep_one(docs, jaccard.SHINGLE, similarity=jaccard.SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text back."""
    found = sentence_pieces.encode(docs)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", tokenization),
]

#: SQL can't express the fingerprints, the classifier or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each stage is written to a folder of its own in the checkpoint directory and read
    again; what the next stage has read goes, and the last one's rows stay there for the caller.
    If a stage fails, all of it goes.
    """
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    place = f"{folder.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, last = read_table(spark, sf_dir, "documents"), None
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
            if last:
                remove(spark, last)
            last = f"{place}/{k}"
            docs = spark.read.parquet(last)
    except BaseException:
        remove(spark, place)
        raise
    return docs
