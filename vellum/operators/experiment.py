"""A retrieval experiment in one call: index a corpus, merge its segments, run all queries, report the metrics."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.api import create_index
from vellum.config import IndexConfig
from vellum.operators.evaluate import evaluate
from vellum.sources.corpora import qrels_path, read_corpus, read_qrels, read_queries

CONFIG = IndexConfig(analyzers={"id": "keyword"}, no_store=("text",), boost={"title": 2.0})
#: The reported metrics look at no more than this many hits.
DEPTH = 100


@dataclass(frozen=True)
class Experiment:
    report: DataFrame
    run: DataFrame
    seconds: dict[str, float]


def run_experiment(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, path: str | None = None, config: IndexConfig = CONFIG, top_k: int = DEPTH, commit_threshold: int | None = 5000, merge: bool = True) -> Experiment:
    """corpus (_id, title, text), queries (query_id, text), qrels (query_id, doc_id, rel).

    Blank queries aren't run; queries that can't be searched have an empty run, and count where they are judged.
    """
    spark, took = corpus.sparkSession, {}
    index = create_index(spark, path, config, commit_threshold)

    def timed(name: str, job) -> None:
        began = time.perf_counter()
        job()
        took[name] = round(time.perf_counter() - began, 3)

    def build() -> None:
        index.writer.add_documents(corpus.select(F.col("_id").alias("id"), "title", "text"))
        index.writer.close()

    timed("index", build)
    if merge:
        timed("merge", lambda: index.merger.merge_all())
    asked = queries.where("query_id is not null and trim(text) <> ''")
    run = index.searcher.search_many(asked, max(top_k, DEPTH)).persist()
    timed("search", run.count)
    return Experiment(evaluate(run.select("query_id", "doc_id", "rank"), qrels, asked.select("query_id")), run, took)


def run_folder(spark: SparkSession, folder: str, split: str | None = None, **more) -> Experiment:
    """The same over a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv."""
    judged = qrels_path(folder, split)
    if judged is None:
        raise ValueError(f"no judgements in {folder}/qrels")
    return run_experiment(read_corpus(spark, f"{folder}/corpus.jsonl"), read_queries(spark, f"{folder}/queries.jsonl"), read_qrels(spark, judged), **more)
