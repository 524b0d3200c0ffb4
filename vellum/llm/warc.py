"""WARC gzip normaliser.

Some writers compress a whole WARC file as one gzip stream, which makes its records unreachable without inflating everything before
them.  The normaliser inflates such a stream once, in pieces, cuts it into records by their Content-Length, writes every record as a gzip
member of its own and writes a sidecar index with each member's offset and length.  Memory use is one piece plus one record.
Files that already have a member for each record, or any other division into members, are read the same way.

A file is one task: a gzip stream can't be entered in its middle.  Tasks write to a name of their own and rename it when
the file is whole, and the bytes depend on the input alone, so a task may be lost or run twice.

Defined results: an empty file gives an empty output and no index rows; a record without content has a payload of length 0; a stream that
breaks off raises an error that names the file and the offset; null urls and pages are written as an empty target or payload and read
back as such; repeated rows are separate records; other columns aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import work_dir

PIECE, LEVEL = 1 << 20, 4
INDEX = "file string, record int, offset bigint, length bigint, raw_length bigint, record_type string, url string, page_id bigint, payload_sha1 string"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """For use in tasks, where there is no JVM; Spark's names of object stores are those of Arrow's file systems but for the scheme."""
    for other in ("s3a://", "s3n://"):
        if path.startswith(other):
            path = "s3://" + path[len(other) :]
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(kind: str, record_id: str, url: str, payload: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One WARC/1.0 record, with the two line ends that close it."""
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8"]
    head += [f"{k}: {v}" for k, v in (extra or {}).items()] + [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def inflate(stream, name: str = "") -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces."""
    z, started, done = zlib.decompressobj(31), False, 0
    while data := stream.read(PIECE):
        done += len(data)
        while data:
            if z.eof:
                data = data.lstrip(b"\0") if not started else data
                if not data:
                    break
                z = zlib.decompressobj(31)
            started = True
            out = z.decompress(data, PIECE)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, started = z.unused_data, False
            elif not data:
                while out := z.decompress(b"", PIECE) if len(out) == PIECE else b"":
                    yield out
    if started and not z.eof:
        raise ValueError(f"gzip stream breaks off after {done} bytes: {name}")


def records(pieces: Iterator[bytes], name: str = "") -> Iterator[tuple[bytes, bytes, bytes]]:
    """(header, payload, whole record) of each record."""
    held = bytearray()
    at = 0

    def more() -> bool:
        nonlocal at
        got = next(pieces, None)
        if got is None:
            return False
        if at:
            del held[:at]
            at = 0
        held.extend(got)
        return True

    while True:
        while len(held) - at < 4 and more():
            pass
        while held[at : at + 2] == b"\r\n":  # more line ends than the format asks for
            at += 2
            while len(held) - at < 4 and more():
                pass
        if len(held) == at:
            return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError(f"record header breaks off: {name}")
        head = bytes(held[at : end + 4])
        size = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if not head.startswith(b"WARC/") or size is None:
            raise ValueError(f"not a WARC record: {name}: {head[:40]!r}")
        need = len(head) + size + 4
        while len(held) - at < need:
            if not more():
                if len(held) - at >= len(head) + size:
                    break  # the last record lacks its closing line ends
                raise ValueError(f"record breaks off: {name}")
        payload = bytes(held[at + len(head) : at + len(head) + size])
        yield head, payload, head + payload + b"\r\n\r\n"
        at = min(at + need, len(held))


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)}


def normalise_file(source: str, target: str, level: int = LEVEL) -> list[tuple]:
    """Writes ``target`` and ``target + '.index.jsonl'``; returns the index rows."""
    disk, where = _place(source)
    out, to = _place(target)
    own = f"{to}.{uuid.uuid4().hex}.part"
    rows, offset = [], 0
    with disk.open_input_stream(where, compression=None) as stream, out.open_output_stream(own, compression=None) as sink:
        for n, (head, payload, whole) in enumerate(records(inflate(stream, source), source)):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(whole) + z.flush()
            sink.write(member)
            f = fields(head)
            page = f.get("x-page-id", "")
            rows.append((target.rsplit("/", 1)[-1], n, offset, len(member), len(whole), f.get("warc-type"), f.get("warc-target-uri"), int(page) if page else None, hashlib.sha1(payload).hexdigest()))
            offset += len(member)
    names = [x.split()[0] for x in INDEX.split(", ")]
    with out.open_output_stream(own + ".index", compression=None) as sink:
        sink.write("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows).encode())
    out.move(own + ".index", to + ".index.jsonl")
    out.move(own, to)
    return rows


def read_record(path: str, offset: int, length: int) -> tuple[bytes, bytes]:
    """(header, payload) of the member at an offset, without reading anything before it."""
    disk, where = _place(path)
    with disk.open_input_file(where) as f:
        whole = gzip.decompress(f.read_at(length, offset))
    head, payload, _ = next(records(iter([whole])))
    return head, payload


def _target_names(sources: list[str]) -> dict[str, str]:
    """A name for each source: its base name, after a hash of its whole path where others have the same."""
    base = {p: p.rsplit("/", 1)[-1] for p in sources}
    count = Counter(base.values())
    return {p: b if count[b] == 1 else f"{hashlib.sha1(p.encode()).hexdigest()[:16]}-{b}" for p, b in base.items()}


def normalise(spark: SparkSession, sources: list[str], target_dir: str, level: int = LEVEL) -> DataFrame:
    """Normalises each file into ``target_dir``; the index of all as a DataFrame.

    The work is done when this returns, and the rows are read from the sidecar indexes that it wrote.
    """
    disk, where = _place(target_dir)
    disk.create_dir(where, recursive=True)
    if not sources:
        return spark.createDataFrame([], INDEX)
    names = _target_names(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                n = len(normalise_file(path, f"{target_dir}/{names[path]}", level))
                yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    files = spark.createDataFrame([(p,) for p in sources], "path string").repartitionByRange(len(sources), "path")
    files.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    return spark.read.schema(INDEX).json([f"{target_dir}/{names[p]}.index.jsonl" for p in sources])


def write_monolithic(pages: DataFrame, target_dir: str, level: int = LEVEL) -> list[str]:
    """Writes the pages as whole-file gzip WARCs, one for each partition; the paths of all."""
    disk, where = _place(target_dir)
    disk.create_dir(where, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{target_dir}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        out, to = _place(name)
        own = f"{to}.{uuid.uuid4().hex}.part"
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        some = False
        with out.open_output_stream(own, compression=None) as sink:
            for b in batches:
                for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    some = True
                    sink.write(z.compress(record("response", str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page}|{url}")), (url or "").replace("\r", "").replace("\n", ""), (html or "").encode("utf-8", "surrogatepass"), {"X-Page-Id": "" if page is None else str(page)})))
            sink.write(z.flush())
        if some:
            out.move(own, to)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])
        else:
            out.delete_file(own)

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return sorted(r["path"] for r in rows.mapInArrow(run, "path string").collect())


def normalised_pages(pages: DataFrame) -> DataFrame:
    """Writes the pages as monolithic files, normalises these, and returns the index of every record."""
    spark = pages.sparkSession
    base = work_dir(spark, "warc")
    return normalise(spark, write_monolithic(pages, f"{base}/whole"), f"{base}/records")
