"""Packing by minimum bin slack.

Texts are measured in words (runs without white space) and cut into pieces of at most one window, between words; a piece that fills a
window is a window of its own and moves nowhere.  For the rest only the multiset of remaining lengths matters, which has less than
``capacity`` distinct values however many documents there are.  The plan is made from that histogram on the driver: the longest length
left opens a window, a subset-sum dynamic program over bitsets (lengths with counts, split into powers of two) finds the
filling closest to the capacity, its counts are read by backtracking, and the pattern is repeated as often as the multiset
allows.  Each repetition limit exhausts the use of some length, so the number of patterns doesn't grow with the data.

Pieces are then ranked within their length, in (doc_id, text hash) order, and a rank belongs to one slot of one window.
The rank comes from counts of (length, bucket) and a row number inside each, so no task sorts all pieces of a length.
At last the pieces of each window meet, with their text.

Defined results: null, empty and blank texts fill no window: each gets a row of its own without a window, with its text; rows repeated whole are
packed once each; null ids sort first; blanks before a text's first word belong to its first piece, other blanks to the piece before them, so the
pieces of a text joined are the text; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.bytewords import buffers, slices

CAPACITY, BUCKETS, BROADCAST_ROWS = 2048, 1 << 16, 500_000
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[x] of each x, whose sum is as near to ``room`` as it can be without exceeding it.

    ``reach`` has bit s set where s is a sum of the items so far; the sets after each item give the way back.
    """
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    items: list[tuple[int, int]] = []
    steps = [1]
    reach = 1
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        n, part = min(counts[length], room // length), 1
        while n > 0 and not reach & full:
            take = min(part, n)
            reach |= (reach << (length * take)) & mask
            items.append((length, take))
            steps.append(reach)
            n -= take
            part *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    used: Counter[int] = Counter()
    for (length, take), before in zip(reversed(items), reversed(steps[:-1])):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern, windows)]: lengths with counts, and how many windows are filled so."""
    left = {x: n for x, n in histogram.items() if n}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        pattern = Counter(best_filling(left, capacity - top))
        left[top] += 1
        pattern[top] += 1
        times = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((dict(pattern), times))
    return out


def _cut(texts: pa.Array, capacity: int) -> tuple[np.ndarray, ...]:
    """(text, piece, first word, words, begin, end) of each piece, in bytes of the texts' buffer; one piece of no words where a text has none."""
    data, at = buffers(texts)
    full = ~BLANK[data]
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    begins[edge] = full[edge]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, at)
    count = np.diff(first)
    parts = np.maximum(-(-count // capacity), 1)
    text = np.repeat(np.arange(len(count)), parts)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    word = piece * capacity
    begin = at[:-1][text]
    inner = np.flatnonzero(piece > 0)
    begin[inner] = start[first[text[inner]] + word[inner]]
    end = np.append(begin[1:], at[-1])
    return text, piece, word, np.minimum(count[text] - word, capacity), begin, end


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_text: bool = True) -> DataFrame:
    """(doc_id, hash, piece, start, length[, text]): the pieces of each row, or one of length 0; a null text stays null."""
    schema = "doc_id bigint, hash bigint, piece int, start bigint, length int" + ", text string" * with_text
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                text, piece, word, n, begin, end = _cut(b.column("text"), capacity)
                take = pa.array(text)
                cols = [b.column("doc_id").take(take), b.column("hash").take(take), pa.array(piece, pa.int32()), pa.array(word, pa.int64()), pa.array(n, pa.int32())]
                if with_text:
                    data = buffers(b.column("text"))[0]
                    body = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(np.append(begin, end[-1:])), pa.py_buffer(data)) if len(text) else pa.array([], pa.large_string())
                    body = body.cast(pa.string())
                    if b.column("text").null_count:
                        body = pc.if_else(b.column("text").take(take).is_null(), pa.scalar(None, pa.string()), body)
                    cols.append(body)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, schema)


def slots(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """The plan by lengths, and its number of windows: (length, low, high, each, window, slot, used) says that the pieces of that length with
    ranks from ``low`` to below ``high`` go to the windows from ``window`` on, ``each`` to a window, in places from ``slot`` on."""
    out, window, taken = [], 0, Counter()
    for pattern, times in plan(histogram, capacity):
        used, slot = sum(x * n for x, n in pattern.items()), 0
        for x, n in sorted(pattern.items(), reverse=True):
            out.append((x, taken[x], taken[x] + n * times, n, window, slot, used))
            taken[x] += n * times
            slot += n
        window += times
    return out, window


def pack(docs: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(window_id, used, slack, doc_ids, pieces): one row for each window, with the text of its pieces in their order, sizes in words.

    Window ids are unique; those of full pieces follow those of the plan, not densely.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(buckets)).cast("int")
    rest = (F.col("length") > 0) & (F.col("length") < capacity)
    # The texts are measured in one pass, and cut and moved in a second: what is counted is at most capacity x buckets rows, and as few as there are pieces.
    per_bucket = pieces(docs, capacity, False).where(rest).groupBy("length", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offset = per_bucket.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {int(r["length"]): int(r["n"]) for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed, windows = slots(histogram, capacity)
    table = spark.createDataFrame(placed, "length int, low bigint, high bigint, each bigint, window bigint, slot bigint, used int")
    # The plan's size depends on the capacity alone; it is sent to all tasks while it is small.
    table = F.broadcast(table) if len(placed) <= broadcast_rows else table
    every = pieces(docs, capacity).withColumn("bucket", bucket)
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "hash"))
    ranked = every.where(rest).withColumn("nth", rank).join(offset, ["length", "bucket"]).withColumn("nth", F.col("nth") - 1 + F.col("before"))
    met = ranked.join(table, "length").where("nth >= low and nth < high")
    at = F.col("nth") - F.col("low")
    fields = ["doc_id", F.col("hash").alias("text_hash"), "piece", "start", "length", "text"]
    placed_at = met.select((F.col("window") + F.floor(at / F.col("each"))).cast("bigint").alias("window_id"), "used", F.struct((F.col("slot") + at % F.col("each")).cast("int").alias("slot"), *fields).alias("p"))
    filled = placed_at.groupBy("window_id", "used").agg(F.array_sort(F.collect_list("p")).alias("p"))
    filled = filled.select("window_id", "used", F.transform("p", lambda p: p.dropFields("slot")).alias("pieces"))
    number = F.lit(windows) + F.monotonically_increasing_id()
    alone = every.where(~rest).withColumn("n", number).select(F.when(F.col("length") > 0, F.col("n")).alias("window_id"), F.when(F.col("length") > 0, F.col("length")).alias("used"), F.array(F.struct(*fields)).alias("pieces"))
    out = filled.unionByName(alone)
    return out.select("window_id", "used", (F.lit(capacity) - F.col("used")).alias("slack"), F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"), "pieces")

