"""Index writer: buffers documents and deletions, commits them as immutable segments."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.config import IndexConfig
from vellum.operators.index_build import field_stats, postings, stored, term_stats, with_ids
from vellum.sources import files
from vellum.sources.store import PathStore, now


@dataclass(frozen=True)
class SegmentInfo:
    segment_id: str
    doc_count: int
    deleted_count: int


def number_rows(docs: DataFrame, order_by: list[str] | None, path: str) -> tuple[DataFrame, int]:
    """Rows with a dense ``_n`` from 0, in order of the given columns or else in the order of the input's partitions, and how many there are.

    The rows are written once, each partition numbers its own, and the partitions' sizes (one row each) give the offsets; no task sees all rows.
    """
    if order_by:
        docs = docs.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    docs.withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    kept = docs.sparkSession.read.parquet(path)
    part = F.shiftright("_m", 33)
    sizes = sorted((r["p"], r["n"]) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    table = docs.sparkSession.createDataFrame(offsets, "_p bigint, _o bigint")
    # One row for each partition of the input.
    return kept.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn("_n", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_o"), total


def counts_in(n: int, threshold: int | None) -> int:
    """Parts into which the terms of one segment are divided: one for each 50 000 documents begun."""
    return max(1, -(-min(n, threshold or n) // 50_000))


def by_segment(stats: DataFrame, parts: int) -> DataFrame:
    """The rows of a segment together, in so many parts; a task then writes to few segments."""
    return stats.repartition("segment_id", F.pmod(F.hash("term"), F.lit(parts)))


class IndexWriter:
    """``commit_threshold`` documents make a segment; None makes one segment of each commit."""

    def __init__(self, store: PathStore, config: IndexConfig | None = None, commit_threshold: int | None = 5000, order_by: list[str] | None = None) -> None:
        self.store, self.config, self.threshold, self.order_by = store, config or IndexConfig(), commit_threshold, order_by
        self._pending: list[DataFrame] = []
        self._deleted: list[str] = []
        self._closed = False
        self._count = 0

    def _open(self) -> None:
        if self._closed:
            raise RuntimeError("IndexWriter has been closed")

    def add_documents(self, docs: DataFrame) -> None:
        """Buffers a DataFrame of documents, one column for each field."""
        self._open()
        self._pending.append(docs)

    def add_document(self, doc: dict) -> None:
        self.add_documents(self.store.spark.createDataFrame([{k: v for k, v in doc.items() if v is not None}]))

    def delete_by_id(self, doc_id: str) -> None:
        self._open()
        self._deleted.append(str(doc_id))

    def commit(self, batch: int | None = None) -> SegmentInfo:
        """Writes what is buffered and publishes it, with the number of a stream's batch; nothing buffered changes nothing.  Returns the last segment."""
        self._open()
        if not self._pending and not self._deleted:
            return SegmentInfo("", 0, 0)
        spark, commit = self.store.spark, f"commit-{uuid.uuid4().hex}"
        entries, ids, counts, fields = self.store.manifest(), [], {}, {}
        if self._pending:
            docs = self._pending[0]
            for d in self._pending[1:]:
                docs = docs.unionByName(d, allowMissingColumns=True)
            numbered, n = number_rows(docs, self.order_by, self.store.table_path("staged", commit))
            step = F.floor(F.col("_n") / self.threshold) if self.threshold else F.lit(0)
            ids = self.store.next_ids(-(-n // self.threshold) if self.threshold else min(n, 1))
            first = int(ids[0].split("-")[1]) if ids else 0
            name = F.format_string("seg-%06d", step.cast("bigint") + first)
            placed = with_ids(numbered, name, F.col("_n") + self._count)
            placed = placed.drop("_n")
            self._count += n
            self.store.write(stored(placed, self.config), "docs", commit)
            self.store.write(postings(placed, self.config), "postings", commit)
            post = spark.read.parquet(self.store.table_path("postings", commit)) if n else None
            if post is not None and post.columns:
                lengths = post.select("segment_id", "field", "doc_ord", "length").distinct()
                self.store.write(by_segment(term_stats(post), counts_in(n, self.threshold)), "term_stats", commit)
                self.store.write(field_stats(lengths), "field_stats", commit)
                for r in spark.read.parquet(self.store.table_path("field_stats", commit)).select("segment_id", "field").collect():
                    fields.setdefault(str(r["segment_id"]), []).append(r["field"])
            counts = {i: min(self.threshold or n, n - k * (self.threshold or n)) for k, i in enumerate(ids)}
        if self._deleted and not ids:
            ids, counts = self.store.next_ids(1), {}
            counts[ids[0]] = 0
        if self._deleted:
            gone = spark.createDataFrame([(ids[-1], d) for d in self._deleted], "segment_id string, doc_id string")
            self.store.write(gone, "tombstones", commit)
        stamp = now()
        entries += [{"id": i, "commit": commit, "doc_count": counts[i], "deleted": len(self._deleted) if i == ids[-1] else 0, "fields": sorted(fields.get(i, [])), "created_at": stamp} for i in ids]
        self.store.publish(entries, batch)
        info = SegmentInfo(ids[-1], counts[ids[-1]], len(self._deleted))
        self._pending, self._deleted = [], []
        files.delete(self.store.table_path("staged", commit))
        return info

    def close(self) -> None:
        """Commits what is left; closing again does nothing."""
        if not self._closed:
            self.commit()
            self._closed = True
