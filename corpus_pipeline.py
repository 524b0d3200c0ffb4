"""The corpus pipeline: five stages from raw documents to packed windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
documents.  All but the last return the columns of ``documents``, with ``n_chars`` brought up to date where a text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontam, hamming_dedup, langid_crf, line_chunks, packing
from vellum.llm.common import discard, table, work_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words, or mostly of tokens of no language, go."""
    return langid_crf.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line of later copies of repeated multi-line passages goes; a document that has no text left stays, empty."""
    out = line_chunks.line_dedup(docs)
    if "n_chars" not in out.columns:
        return out
    kind = out.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return hamming_dedup.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document meet in windows, with their text."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: A trained random field, signatures and subset-sum plans can't be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    base = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last:
            discard(spark, last)
        last = f"{base}/{name}"
    return docs
