"""Document fingerprints: a canonical exact digest.

Texts are canonicalised (NFKC, case folding, runs of white space to one blank, no blanks at the ends), digested with
128-bit xxh3, grouped by digest, and inside a group of equal digests compared byte for byte, so a
digest collision never makes two documents equal.

Defined results: a null text has no fingerprint and is never a copy (keeper is itself, group size 1); empty and
blank texts are equal to each other; rows that repeat an id are separate members of their group, each counted; the keeper is the
lowest doc_id of the group, null ids last; NFKC and case folding also make ligatures, full-width letters and sharp s equal to their plain forms; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bytewords import slices
from vellum.llm.common import cut

BROADCAST_ROWS = 1 << 20


def canonical(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def wide_digest(body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body)


def digests(docs: DataFrame, with_body: bool = False, digest: Callable[[bytes], bytes] = wide_digest) -> DataFrame:
    """(id, hi, lo[, body]): the digest of each row that has a text, and its canonical form."""
    schema = "id bigint, hi bigint, lo bigint" + ", body binary" * with_body
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                bodies = [canonical(t).encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                sums = np.frombuffer(b"".join(map(digest, bodies)), dtype=">i8").astype(np.int64).reshape(-1, 2)
                cols = [batch.column("id"), pa.array(sums[:, 0]), pa.array(sums[:, 1])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(bodies, pa.binary())] * with_body, names=names)

    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


def fingerprint_groups(docs: DataFrame, digest: Callable[[bytes], bytes] = wide_digest, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, keeper_doc_id, group_size, is_copy) of every row.

    Digests alone are shuffled for the grouping.  While the digests that occur twice are few enough to be sent to all tasks, only the
    bodies that have one of them move, and beyond that all; the aggregation over them combines before the shuffle, so a text with
    a million copies is no hot spot.
    """
    light = cut(digests(docs, digest=digest))
    twice = cut(light.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo"))
    few = F.broadcast(twice) if twice.count() <= broadcast_rows else twice
    member = digests(docs, True, digest).join(few, ["hi", "lo"], "left_semi")
    per_body = member.groupBy("hi", "lo", "body").agg(F.min("id").alias("keeper"), F.count("*").alias("n"))
    group = cut(per_body.groupBy("hi", "lo").agg(F.count("*").alias("bodies"), F.min("keeper").alias("keeper"), F.sum("n").alias("n")))
    out = ("id", "keeper", "n")
    if group.where("bodies > 1").isEmpty():
        found = light.join(group, ["hi", "lo"], "left").select(*out)
    else:  # digests that collide: their documents are grouped by their bodies
        clash = group.where("bodies > 1").select("hi", "lo")
        found = light.join(clash, ["hi", "lo"], "left_anti").join(group, ["hi", "lo"], "left").select(*out)
        found = found.unionByName(member.join(clash, ["hi", "lo"], "left_semi").join(per_body, ["hi", "lo", "body"]).select(*out))
    found = found.unionByName(docs.where(F.col("text").isNull()).select(F.col("doc_id").cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("keeper"), F.lit(1).cast("bigint").alias("n")))
    keeper, size = F.coalesce("keeper", "id"), F.coalesce("n", F.lit(1))
    return found.select(F.col("id").alias("doc_id"), keeper.alias("keeper_doc_id"), size.alias("group_size"), (~F.col("id").eqNullSafe(keeper)).alias("is_copy"))


def oracle() -> str:
    form = "trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g'))"
    return f"""
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER w END AS keeper_doc_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER w END AS group_size,
       CASE WHEN text IS NULL THEN false ELSE doc_id <> min(doc_id) OVER w END AS is_copy
FROM (SELECT doc_id, text, {form} AS body FROM documents) WINDOW w AS (PARTITION BY body)"""
