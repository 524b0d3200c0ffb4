"""The library's front door: an index with a writer, a searcher and a merger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from vellum.config import IndexConfig, MergePolicy
from vellum.operators.batch import search_many
from vellum.operators.index_build import Snapshot
from vellum.operators.merge import SegmentMerger
from vellum.operators.scoring import BM25, Scorer
from vellum.operators.search import search
from vellum.operators.writer import IndexWriter
from vellum.plans.compile import RANGE_ERROR
from vellum.plans.parser import contains_range, parse
from vellum.sources.store import MemoryStore, PathStore

RESULT = "doc struct<id:string>, score double, doc_id string, segment_id string"


class IndexSearcher:
    def __init__(self, store: PathStore, config: IndexConfig | None = None, scorer: Scorer | None = None) -> None:
        self.store, self.config, self.scorer = store, config or IndexConfig(), scorer or BM25()
        self._seen: list | None = None
        self._snap: Snapshot | None = None

    def snapshot(self) -> Snapshot | None:
        """The current index; opened again when the manifest has changed."""
        now = self.store.manifest()
        if now != self._seen:
            self._snap, self._seen = self.store.snapshot(), now
        return self._snap

    def search(self, query: str, top_k: int | None = 10, filter: Column | None = None) -> DataFrame:
        snap = self.snapshot()
        if snap is None:
            if contains_range(parse(query)):
                raise ValueError(RANGE_ERROR)
            return self.store.spark.createDataFrame([], RESULT)
        return search(snap, query, self.config, top_k, filter, self.scorer)

    def search_many(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, segment_id, score) for each (query_id, text)."""
        snap = self.snapshot()
        if snap is None:
            return self.store.spark.createDataFrame([], "query_id string, rank int, doc_id string, segment_id string, score double")
        return search_many(snap, queries, self.config, top_k, self.scorer)

    def refresh(self) -> None:
        """Forgets the opened index."""
        self._snap, self._seen = None, None
        self.store.refresh()


@dataclass(frozen=True)
class Index:
    writer: IndexWriter
    searcher: IndexSearcher
    merger: SegmentMerger


def create_index(spark: SparkSession, path: str | None = None, config: IndexConfig | None = None, commit_threshold: int | None = 5000, order_by: list[str] | None = None, scorer: Scorer | None = None, policy: MergePolicy | None = None) -> Index:
    """An index in a folder or under an object-store URI, or without a path in a temporary one."""
    store = PathStore(spark, path) if path else MemoryStore(spark)
    return Index(IndexWriter(store, config, commit_threshold, order_by), IndexSearcher(store, config, scorer), SegmentMerger(store, policy))
