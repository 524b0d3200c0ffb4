"""Helpers that the operators of this subpackage share.

Row identity.  A document row is known by ``doc_id`` and a hash of its text, both compared null-safely.
Rows that repeat both are the same document and always get the same decision.  The caller's columns are
kept inside one struct while an operator works, so no name of theirs can clash with one of ours.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW, ID, HASH = "row", "id", "hash"


def nested(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row struct, id, hash): the given columns inside ``row``."""
    packed = docs.select(F.struct("*").alias(ROW))
    return packed.select(ROW, F.col(f"{ROW}.{key}").cast("bigint").alias(ID), F.xxhash64(f"{ROW}.{text}").alias(HASH))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(id, hash, text) of every row."""
    return docs.select(F.col("doc_id").cast("bigint").alias(ID), F.xxhash64("text").alias(HASH), F.col("text").cast("string").alias("text"))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a[ID].eqNullSafe(b[ID]) & (a[HASH] == b[HASH])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  A local one is made only where the session names none and runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def work_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate results, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared folder, so a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
