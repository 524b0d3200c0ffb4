"""Index stores.  A segment is a folder of Parquet tables that never changes; the manifest names the segments in order.

Everything of a segment is written before the manifest that names it, and the manifest is replaced at once, so readers see
whole commits only.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vellum.operators.index_build import Snapshot
from vellum.sources import files

POSTINGS = "segment_id string, field string, term string, doc_ord bigint, tf int, positions array<int>, length int"
SCHEMAS = {
    "postings": POSTINGS,
    "term_stats": "segment_id string, field string, term string, df bigint",
    "field_stats": "segment_id string, field string, doc_count bigint, avg_length double",
    "tombstones": "segment_id string, doc_id string",
}


class PathStore:
    """A folder or an object-store prefix (any URI that Spark reads, such as s3a://)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> list[dict]:
        """Entries {id, doc_count, deleted, fields, created_at}; none where there is no manifest, an error where it can't be read."""
        where = f"{self.path}/segments.json"
        return files.read_json(where)["segments"] if files.exists(where) else []

    def batch(self) -> int:
        """The last stream batch that is part of the index; -1 before the first."""
        where = f"{self.path}/segments.json"
        return files.read_json(where).get("batch", -1) if files.exists(where) else -1

    def publish(self, entries: list[dict], batch: int | None = None) -> None:
        """Replaces the manifest; a stream's batch number is published with its segments, or stays as it was."""
        files.write_json(f"{self.path}/segments.json", {"segments": entries, "batch": self.batch() if batch is None else batch})

    def next_ids(self, n: int) -> list[str]:
        last = max((int(e["id"].split("-")[1]) for e in self.manifest()), default=0)
        return [f"seg-{last + 1 + i:06d}" for i in range(n)]

    def table_path(self, name: str, commit: str) -> str:
        return f"{self.path}/{commit}/{name}"

    def write(self, df: DataFrame, name: str, commit: str) -> None:
        """One folder for each segment.  Postings are laid out by (field, term) in each file, so that a term's row groups are few.

        Nothing is shuffled: documents come in the order of their segments, so a task writes to few of them.
        """
        if name in ("postings", "term_stats"):
            df = df.sortWithinPartitions("segment_id", "field", "term")
        df.write.mode("overwrite").partitionBy("segment_id").parquet(self.table_path(name, commit))

    def _read(self, name: str, entries: list[dict]) -> DataFrame | None:
        paths = list(dict.fromkeys(self.table_path(name, e["commit"]) for e in entries))
        paths = [p for p in paths if files.exists(p)]
        if not paths:
            return None
        ids = [e["id"] for e in entries]
        parts = []
        for p in paths:
            schema = SCHEMAS.get(name)
            reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", "true")
            try:
                parts.append(reader.parquet(p))
            except AnalysisException:
                if schema:
                    raise
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out.where(F.col("segment_id").isin(ids))

    def snapshot(self) -> Snapshot | None:
        """The index as the manifest has it now; None where it holds no segment."""
        entries = self.manifest()
        if not entries:
            return None
        order = {e["id"]: i for i, e in enumerate(entries)}
        meta = self.spark.createDataFrame([(e["id"], order[e["id"]], e["doc_count"]) for e in entries], "segment_id string, seg_ord bigint, doc_count bigint")
        empty = lambda n: self.spark.createDataFrame([], SCHEMAS[n])
        with_docs = [e for e in entries if e["doc_count"]]
        docs = self._read("docs", with_docs)
        if docs is None:
            docs = self.spark.createDataFrame([], "segment_id string, doc_ord bigint, doc_id string, doc struct<id:string>")
        get = lambda n: (lambda x: empty(n) if x is None else x)(self._read(n, with_docs))
        dead = [e for e in entries if e["deleted"]]
        gone = self._read("tombstones", dead) if dead else None
        fields = sorted({f for e in entries for f in e["fields"]})
        return Snapshot(docs, get("postings"), get("term_stats"), get("field_stats"), meta, gone, fields, sum(e["deleted"] for e in entries), len(entries))

    def refresh(self) -> None:
        """Forgets what Spark remembers of the files."""
        self.spark.catalog.refreshByPath(self.path)


class MemoryStore(PathStore):
    """A store for tests and notebooks, in a folder of its own that ``close`` removes; on a cluster it lies in the session's shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or give the index a path")
        super().__init__(spark, f"{shared.rstrip('/')}/vellum-index-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="vellum-index-"))

    def dump(self) -> dict[str, list[str]]:
        return {e["id"]: files.names(f"{self.path}/{e['commit']}") for e in self.manifest()}

    def close(self) -> None:
        files.delete(self.path)


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
