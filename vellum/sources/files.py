"""Files by path or URI through Hadoop's file systems, so that whatever Spark reads and writes (local folders, HDFS, s3a:// and other
object stores) is handled alike, with the session's own settings.  For use on the driver."""

from __future__ import annotations

import json
import uuid

from pyspark import SparkContext

#: File systems whose rename replaces the target at once; elsewhere a file becomes visible as a whole when it is closed.
RENAMES = ("file", "hdfs", "viewfs")


def _open(path: str):
    """(context, file system, path) of a path; one without a scheme is local."""
    sc = SparkContext._active_spark_context
    if sc is None:
        raise RuntimeError("no Spark session is running")
    where = sc._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file:{path}" if path.startswith("/") else path)
    return sc, where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    _, disk, where = _open(path)
    return disk.exists(where)


def read_json(path: str):
    sc, disk, where = _open(path)
    stream = disk.open(where)
    try:
        return json.loads(sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(path: str, value) -> None:
    """Whole or not at all, whatever stood there before."""
    sc, disk, where = _open(path)
    rename = disk.getUri().getScheme() in RENAMES
    own = where.suffix(f".{uuid.uuid4().hex}") if rename else where
    out = disk.create(own, True)
    try:
        out.write(json.dumps(value).encode())
    finally:
        out.close()
    if rename:
        how = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(disk.getUri(), sc._jsc.hadoopConfiguration()).rename(own, where, how)


def delete(path: str) -> None:
    """A file or a whole folder; nothing where there is none."""
    _, disk, where = _open(path)
    disk.delete(where, True)


def names(path: str) -> list[str]:
    """Names in a folder; none where the folder is missing."""
    _, disk, where = _open(path)
    return sorted(s.getPath().getName() for s in disk.listStatus(where)) if disk.exists(where) else []
