"""Line dedup by content-defined line chunks.

A rolling hash over the hashes of the last two lines decides after which lines a chunk ends, one in ``divisor``, so the same lines give the same
chunks wherever they stand.  What is compared are multi-line passages of whole chunks: from each chunk on, and up to each chunk,
as few neighbouring chunks as have ``min_lines`` lines.  Passages that occur more than once anywhere are removed, all but the first in
(doc_id, text hash, line) order; equal hashes only nominate passages, equality of their bytes decides.

What a repeated passage has before its first boundary and after its last one stays: the price of a large divisor.  With divisor 1, the
default, every line is a boundary and nothing is lost: each line of every repeated passage of ``min_lines`` lines or more goes.

Blank lines belong to no chunk, but go with the passage around them.  Defined results: null text stays null, an empty text stays
empty, rows repeated whole count as one document and keep or lose the same lines, a text that loses all its lines becomes the empty
string, null ids sort first, an empty table gives an empty table, other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.bytewords import buffers, mix, slices, span_hashes
from vellum.llm.common import HASH, ID, ROW, cut, nested, same_document

DIVISOR, MIN_LINES, SALTS = 1, 2, 16
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lines(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of the texts, begin and end of each line in them, and the number of each text's first line."""
    data, at = buffers(texts)
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, at)
    first = before + np.arange(len(at))
    begin, end = np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int64)
    inner = np.ones(first[-1], dtype=bool)
    inner[first[:-1]] = False
    begin[first[:-1]], begin[inner] = at[:-1], breaks + 1
    inner = np.ones(first[-1], dtype=bool)
    inner[first[1:] - 1] = False
    end[first[1:] - 1], end[inner] = at[1:], breaks
    return data, begin, end, first


def passages(texts: pa.Array, divisor: int, min_lines: int) -> tuple[np.ndarray, ...]:
    """(text, hash, first line, last line) of each passage to compare; lines are numbered from 0 in each text."""
    data, begin, end, first = lines(texts)
    marks = np.concatenate([[0], np.cumsum(~BLANK[data])])
    full = np.flatnonzero(marks[end] > marks[begin])
    doc = np.searchsorted(first, full, "right") - 1
    if not len(full):
        return (full,) * 4
    last = np.ones(len(full), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    if divisor > 1:
        value = span_hashes(data, begin[full], end[full])
        before = np.where(np.concatenate([[True], last[:-1]]), np.uint64(0), np.concatenate([[np.uint64(0)], value[:-1]]))
        last |= mix(value * _BASE + before) % np.uint64(divisor) == 0
    else:
        last[:] = True
    z = np.flatnonzero(last)
    a = np.concatenate([[0], z[:-1] + 1])
    owner, total = doc[a], np.concatenate([[0], np.cumsum(z - a + 1)])
    chunk = np.arange(len(a))
    to = np.searchsorted(total, total[:-1] + min_lines, "left") - 1
    since = np.searchsorted(total, total[1:] - min_lines, "right") - 1
    runs = [(chunk[ok], to[ok]) for ok in [np.flatnonzero((to < len(a)) & (owner[np.minimum(to, len(a) - 1)] == owner))]]
    runs += [(since[ok], chunk[ok]) for ok in [np.flatnonzero((since >= 0) & (owner[np.maximum(since, 0)] == owner))]]
    run = np.unique(np.concatenate([x for x, _ in runs]) * len(a) + np.concatenate([y for _, y in runs]))
    x, y = full[a[run // len(a)]], full[z[run % len(a)]]
    text = owner[run // len(a)]
    return text, span_hashes(data, begin[x], end[y]).view(np.int64), x - first[text], y - first[text]


def _units(divisor: int, min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                text, value, x, y = passages(b.column("text"), divisor, min_lines)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column(ID).take(take), b.column(HASH).take(take), pa.array(value), pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=[ID, HASH, "h", "a", "b"])

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the passages that ``marks`` lists."""
    for whole in batches:
        flat = pa.RecordBatch.from_arrays([whole.column(ROW).field("text").cast(pa.string()), whole.column(ID), whole.column(HASH), whole.column("marks")], names=["text", ID, HASH, "marks"])
        for b in slices(flat):
            data, begin, end, first = lines(b.column("text"))
            marks = b.column("marks")
            every = marks.flatten()
            doc = np.repeat(np.arange(b.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
            h, x, y = (every.field(n).to_numpy(zero_copy_only=False) for n in ("h", "a", "b"))
            start, stop = begin[first[doc] + x].tolist(), end[first[doc] + y].tolist()
            blob = data.tobytes()
            for k in range(0, len(doc), 10000):
                s = slice(k, k + 10000)
                take = pa.array(doc[s])
                body = pa.array([blob[i:j] for i, j in zip(start[s], stop[s])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(ID).take(take), b.column(HASH).take(take), pa.array(h[s]), pa.array(x[s]), pa.array(y[s]), body], names=[ID, HASH, "h", "a", "b", "body"])


def _with_bodies(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, hash, h, a, b, body) of the given passages.

    The whole row goes to Python, so that the shuffle of the rows is the one that the removal needs too, and is made once.
    """
    marks = shared.groupBy(ID, HASH).agg(F.collect_set(F.struct("h", "a", "b")).alias("marks"))
    both = rows.join(marks.hint("shuffle_hash"), same_document(rows, marks)).select(rows[ROW], rows[ID], rows[HASH], marks["marks"])
    return both.mapInArrow(_bodies, f"{ID} bigint, {HASH} bigint, h bigint, a int, b int, body binary")


def _later(rows: DataFrame, divisor: int, min_lines: int, salts: int) -> DataFrame:
    """(id, hash, a, b): every repeated passage but the first of its kind, by its first and last line."""
    texts = rows.where(F.col(f"{ROW}.text").isNotNull()).select(ID, HASH, F.col(f"{ROW}.text").cast("string").alias("text"))
    units = texts.mapInArrow(_units(divisor, min_lines), f"{ID} bigint, {HASH} bigint, h bigint, a int, b int")
    twice = units.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = cut(units.join(twice, "h", "left_semi"))
    place = F.struct(ID, HASH, "a", "b")
    # Combined before the shuffle, so a passage that half the corpus holds is no hot spot.  One body for a hash: all are equal.
    kinds = _with_bodies(rows, shared).groupBy("h").agg(F.min(place).alias("first"), (F.min("body") == F.max("body")).alias("same"))
    marked = shared.join(kinds, "h")
    later = marked.where(F.col("same") & (place > F.col("first"))).select(ID, HASH, "a", "b")
    # Hashes that deceive: their passages are ranked by their bytes, in `salts` parts first.  With `first` in it, the condition needs the same kinds as above.
    near = _with_bodies(rows, marked.where(~F.col("same") & F.col("first").isNotNull()).select(ID, HASH, "h", "a", "b")).withColumn("salt", F.pmod(F.hash(ID, HASH, "a", "b"), F.lit(salts)))
    order = (F.col(ID).asc_nulls_first(), HASH, "a", "b")
    near = near.withColumn("nth", F.rank().over(Window.partitionBy("h", "salt", "body").orderBy(*order)))
    heads = near.where("nth = 1").withColumn("nth", F.rank().over(Window.partitionBy("h", "body").orderBy(*order)))
    for some in (near, heads):
        later = later.unionAll(some.where("nth > 1").select(ID, HASH, "a", "b"))
    return later


def line_dedup(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, salts: int = SALTS) -> DataFrame:
    """The same rows and columns, ``text`` without the later copies of repeated passages."""
    if divisor < 1 or min_lines < 1:
        raise ValueError("divisor and min_lines must be positive")
    rows = nested(docs)
    gone = _later(rows, divisor, min_lines, salts).select(ID, HASH, F.explode(F.sequence("a", "b")).alias("line")).groupBy(ID, HASH).agg(F.collect_set("line").alias("gone"))
    both = rows.join(gone.hint("shuffle_hash"), same_document(rows, gone), "left").select(rows[ROW], gone["gone"])
    text = F.col(f"{ROW}.text")
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(text, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    new = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return both.withColumn(ROW, F.col(ROW).withField("text", new)).select(f"{ROW}.*")


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL for (doc_id, text) after line_dedup by its defaults over distinct doc_ids."""
    return f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {docs} WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
f AS (SELECT doc_id, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM e WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]')),
p AS (SELECT f.doc_id, a, b, array_to_string(list_slice(ls, a, b), chr(10)) AS body FROM f JOIN l ON f.doc_id = l.doc_id WHERE b IS NOT NULL),
r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS nth FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM r WHERE nth > 1),
t AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.i) AS text FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text FROM {docs} d LEFT JOIN t ON d.doc_id = t.doc_id"""
