"""Extension: an index fed by a stream, one commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vellum.config import IndexConfig
from vellum.operators.writer import IndexWriter
from vellum.sources.store import PathStore


def index_stream(stream: DataFrame, store: PathStore, config: IndexConfig | None = None, checkpoint: str | None = None, commit_threshold: int | None = None, **trigger) -> StreamingQuery:
    """Commits every micro-batch as new segments.  A batch that is run again after a failure isn't committed twice: its number is published
    in the same manifest as its segments."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        if store.batch() < batch_id and not batch.isEmpty():
            writer = IndexWriter(store, config, commit_threshold)
            writer.add_documents(batch)
            writer.commit(batch_id)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint or f"{store.path}/stream-checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
