"""A document corpus from raw to packed: each stage reads what the one before it has written.

Stages: quality rules (rejected documents go, lines that too many documents of a source share are cut), near-duplicate removal (one
document of each group stays), substring removal (words in passages of an earlier document go), secrets replaced, packing.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows, an empty table, and columns of any name besides
``doc_id``, ``text`` and ``source``; all but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.functions.durable import shared_path
from roadsift.llm import minhash, packing, rules, secret_scan, substrings
from roadsift.llm.queries import prepared

SECRET_MARK = "[secret]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that more than 100 documents of a source share (the smallest id keeps them).

    Null and empty texts fail.  Rows with the same id count as one document of a line; repeated rows stay repeated."""
    prepared(spark)
    return sized(rules.apply_rules(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8; the smallest id of a group stays.

    Texts without words are linked with nothing and stay, as do rows with a null id; rows with the same id are one document, whose rows all stay or all go."""
    prepared(spark)
    groups = minhash.near_duplicates(docs, words=5, percent=80)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that lie in thirteen-word windows of a document with a smaller id.

    A text that loses nothing stays as it is, white space included, and null stays null; rows with a null id or with the same id take
    nothing from each other."""
    prepared(spark)
    out = substrings.remove_repeats(docs, size=13, as_it_was=True)
    return sized(out.select(*[F.col("kept").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; overlapping ones are replaced together.  Null stays null; every row stays."""
    prepared(spark)
    return sized(secret_scan.redact(docs, secret_scan.Ledger(spark), mark=SECRET_MARK))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised texts in sequences of at most 2048 ids.  A null or empty text is the closing id alone; repeated rows are documents of their own."""
    prepared(spark)
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), closing_id=1, capacity=2048)
    return packed.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def sized(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` as the text now has; null stays null."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scan", secrets), ("packing", pack)]

ORACLE_SQL = None  # byte-pair encoding and registers have no SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
