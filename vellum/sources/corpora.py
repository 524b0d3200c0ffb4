"""Readers of retrieval benchmarks: corpus and queries in JSON lines, judgements in tab-separated files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.sources import files

SPLITS = ("test", "dev", "train")


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of well-formed lines, with the line's file and place; byte-order marks, blank and malformed lines are passed over."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where("trim(value) <> ''")
    parsed = text.select("file", "line", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("file", "line", "r.*").drop("_bad")


def malformed_lines(spark: SparkSession, path: str, most: int = 3) -> list[str]:
    """The first few lines that ``read_corpus`` passes over, with a warning for each."""
    text = spark.read.text(path).where("trim(value) <> ''").select(F.regexp_replace("value", "^﻿", "").alias("value"))
    bad = [r["value"] for r in text.where(F.try_parse_json("value").isNull()).limit(most).collect()]
    for line in bad:
        warnings.warn(f"malformed line: {line[:80]}", stacklevel=2)
    return bad


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(_id, title, text) of a JSON-lines corpus."""
    return _json_lines(spark, path, "_id string, title string, text string").select("_id", "title", "text")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of rows with an id and a text that isn't blank; the last of equal ids counts."""
    rows = _json_lines(spark, path, "_id string, text string").where("_id is not null and trim(text) <> ''")
    last = Window.partitionBy("_id").orderBy(F.desc("file"), F.desc("line"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").select(F.col("_id").alias("query_id"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel); the first line is a header; scores are read up to their first non-digit; the last of equal pairs counts."""
    rows = spark.read.option("header", "true").option("sep", "\t").option("quote", "").schema("query_id string, doc_id string, score string").csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    number = F.regexp_extract("score", r"^\s*([+-]?\d+)", 1)
    rows = rows.where(number != "").withColumn("rel", number.try_cast("int")).where("query_id is not null and doc_id is not null and rel is not null")
    last = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("file"), F.desc("line"))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").select("query_id", "doc_id", "rel")


def from_parquet(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Corpus, queries or qrels kept as Parquet shards, whose columns go by several names."""
    names = {
        "corpus": {"_id": ("_id", "id", "docid", "doc_id"), "title": ("title",), "text": ("text", "contents", "body")},
        "queries": {"query_id": ("_id", "id", "query_id", "query-id"), "text": ("text", "query")},
        "qrels": {"query_id": ("query-id", "query_id", "qid"), "doc_id": ("corpus-id", "corpus_id", "doc_id", "docid"), "rel": ("score", "rel", "relevance")},
    }[kind]
    df = spark.read.parquet(path)

    def pick(choices: tuple[str, ...]) -> F.Column:
        have = [F.col(f"`{c}`") for c in choices if c in df.columns]
        return F.coalesce(*have) if have else F.lit("" if "title" in choices else None)

    return df.select(*[pick(c).cast("int" if n == "rel" else "string").alias(n) for n, c in names.items()])


def qrels_path(folder: str, split: str | None = None) -> str | None:
    """The judgements of the wished split, else of test, dev or train, whichever is there first."""
    for name in dict.fromkeys([*([split] if split else []), *SPLITS]):
        if files.exists(f"{folder}/qrels/{name}.tsv"):
            return f"{folder}/qrels/{name}.tsv"
    return None
