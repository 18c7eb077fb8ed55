"""A training corpus in five stages; each works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontaminate, near_copies, pieces, quality, suffix_dedup
from netloom.llm.common import mark, release, remove, shared_dir, table
from netloom.llm.token_counts import model_bytes


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a five-word Jaccard similarity of 0.8 or more."""
    return near_copies.one_per_group(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of 100-byte strings that start earlier in the corpus, and without characters
    that a cut leaves incomplete; a null text stays null."""
    kept = suffix_dedup.dedup_substrings(docs, whole="__whole")
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.col("__whole"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, the text decoded from them and whether the two libraries' ids differ."""
    return pieces.encode_pieces(docs, model_bytes("piece_bpe_32k.model"), decoded="decoded").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", good),
    ("simhash near-dedup", distinct),
    ("suffix-array dedup", unrepeated),
    ("benchmark decontamination", uncontaminated),
    ("sentencepiece encoding", encoded),
]
ORACLE_SQL = None  # no stage but the fourth can be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        begin = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        release(spark, begin)  # the stage's own intermediate tables, and what it read
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
