"""Queries of this subpackage's operators, over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from vellum.llm import decontam, fingerprint, hamming_dedup, html_bp, langid_crf, line_chunks, lpf_dedup, packing, quality_fm, warc
from vellum.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_crf.identify(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.removed_repeats(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_groups(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_dedup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "keeper_doc_id", "group_size")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.normalised_pages(table(spark, sf_dir, "pages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_bp.extract(pages, html_bp.train(html_bp.labelled_pages(pages, table(spark, sf_dir, "documents"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_language_id, op2_line_dedup, op3_packing, op4_quality_classifier, op5_benchmark_decontamination, op6_suffix_array_dedup,
    op7_document_fingerprints, op8_minhash_near_dedup, op9_warc, op10_html_extraction, pipeline,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_chunks.oracle(),
    "op5_benchmark_decontamination": decontam.oracle(),
    "op6_suffix_array_dedup": lpf_dedup.oracle(),
    "op7_document_fingerprints": fingerprint.oracle(),
}
