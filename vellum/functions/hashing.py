"""FNV-1a bucket hashing of term keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME, MIN_BUCKETS, DOCS_PER_BUCKET = 2166136261, 16777619, 64, 1000


def bucket_for(key: Column, buckets: Column | int) -> Column:
    """FNV-1a (32 bits) over the key's UTF-16 code units, modulo the number of buckets."""
    units = F.hex(F.encode(key, "UTF-16BE"))
    count = (F.length(units) / 4).cast("int")
    codes = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.conv(F.substring(units, i * 4 + 1, 4), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(PRIME)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(codes, F.lit(OFFSET).cast("bigint"), step) % buckets


def bucket_for_key(key: str, buckets: int) -> int:
    h, data = OFFSET, key.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] << 8 | data[i + 1])) * PRIME) & 0xFFFFFFFF
    return h % buckets


def num_buckets_for(docs: Column | int) -> Column | int:
    """At least 64, else one for each thousand documents begun."""
    if isinstance(docs, int):
        return max(MIN_BUCKETS, -(-docs // DOCS_PER_BUCKET))
    return F.greatest(F.lit(MIN_BUCKETS).cast("bigint"), F.ceil(docs / DOCS_PER_BUCKET))


def bucket_filename(bucket: int) -> str:
    return f"postings/bucket-{bucket}.json"
