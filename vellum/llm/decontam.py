"""Benchmark decontamination with suffix arrays over the training texts.

Each task builds suffix arrays over shards of about ``SHARD_BYTES`` bytes of its own documents, looks up every suffix of
every benchmark item by binary search, and extends each hit that no earlier one covers to the longest match, whose bytes are then compared.
A document with a match of ``min_words`` words or more is affected and removed.  Words are compared in lower case and without what
stands between them; a match is verbatim in these words.  An item with fewer than ``min_words`` words counts when all of it
occurs, provided it has at least ``least_item`` words.

The training texts are never shuffled.  The benchmark is sent to the tasks in parts of at most
``PART_BYTES``; however large it is, each part takes one pass and no part is left out.

Defined results: null, empty and wordless texts and items match nothing and stay; rows repeated whole are each
reported and go together; several items with one id are reported under it, with the longest match; ties go to the
earliest place in the document, then in the item; a text and an item that repeat one word throughout match over the shorter's length; empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bytewords import Words, slices, words
from vellum.llm.suffixes import Prefixes, first_keys, number_words, suffix_array

MIN_WORDS, LEAST_ITEM, SHARD_BYTES, PART_BYTES, PAIRS = 13, 5, 4 << 20, 16 << 20, 1 << 18


class Items:
    """Benchmark items ready for search: word hashes of all, one after the other, and their bytes for the final comparison."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int, least_item: int) -> None:
        w = words(pa.array(texts, pa.string()))
        self.ids = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        self.null = np.array([i is None for i in ids], dtype=bool)
        self.words, self.hashes, self.first = w, w.hashes(), w.first
        n = np.diff(w.first)
        need = np.where(n >= min_words, min_words, np.where(n >= least_item, n, 0))
        item = w.doc()
        at = np.arange(len(item)) - w.first[:-1][item]
        # Suffixes long enough to hold a match that counts.
        self.start = np.flatnonzero((need[item] > 0) & (n[item] - at >= need[item]))
        self.item, self.at, self.need = item[self.start], at[self.start], need[item[self.start]]
        self.room = n[self.item] - self.at


def _best(text: np.ndarray, item: np.ndarray, length: np.ndarray, place: np.ndarray, item_place: np.ndarray) -> tuple[np.ndarray, ...]:
    """The longest match of each text with each item, the earliest of equals."""
    order = np.lexsort((item_place, place, -length, item, text))
    text, item, length, place, item_place = (x[order] for x in (text, item, length, place, item_place))
    best = np.ones(len(text), dtype=bool)
    best[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    return text[best], item[best], length[best], place[best], item_place[best]


def _beginnings(pos: np.ndarray, group: np.ndarray, group_before: np.ndarray, query: np.ndarray, of: np.ndarray, of_before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pos, query) pairs of one group whose predecessors aren't pairs themselves, in blocks of about ``PAIRS``.

    A pair whose predecessor is a pair belongs to a longer match, which begins earlier.  In the order of (group, group before) the pairs
    to leave out are one run for each query, so they aren't even made: a word repeated through text and item costs their lengths, not the product.
    """
    wide = int(max(group.max(), group_before.max(), of_before.max(initial=0))) + 3
    key = group * wide + group_before + 2
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    low, high = np.searchsorted(key, of * wide), np.searchsorted(key, (of + 1) * wide)
    skip = np.where(of_before >= 0, of * wide + of_before + 2, of * wide)
    a, b = np.searchsorted(key, skip, "left"), np.searchsorted(key, skip, "right")
    a, b = np.where(of_before >= 0, a, low), np.where(of_before >= 0, b, low)
    start, size = np.concatenate([low, b]), np.concatenate([a - low, high - b])
    query = np.concatenate([query, query])
    some = size > 0
    start, size, query = start[some], size[some], query[some]
    # One query's run may be longer than a block: runs are cut.
    parts = -(-size // PAIRS)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, size, query = np.repeat(start, parts) + nth * PAIRS, np.minimum(np.repeat(size, parts) - nth * PAIRS, PAIRS), np.repeat(query, parts)
    total = np.cumsum(size)
    x = 0
    while x < len(size):
        z = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + PAIRS, "right")))
        n = size[x:z]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[x:z], n)
        yield pos[inner], np.repeat(query[x:z], n)
        x = z


def _verbatim(w: Words, items: Items, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The same matches, after a comparison of their words' bytes; where hashes deceived, the pair of text and item is searched word by word."""
    text, item, length, place, item_place = found
    keep = np.ones(len(text), dtype=bool)
    v = items.words
    spell = lambda x, a, z: [x.data[i:j].tobytes() for i, j in zip(x.start[a:z].tolist(), x.end[a:z].tolist())]
    for i, (t, k, n, p, q) in enumerate(zip(*(x.tolist() for x in found))):
        a, b = w.first[t] + p, v.first[k] + q
        if spell(w, a, a + n) == spell(v, b, b + n):
            continue
        here, there, best, run = spell(w, w.first[t], w.first[t + 1]), spell(v, v.first[k], v.first[k + 1]), None, {}
        for x, word in enumerate(here):
            run = {y: run.get(y - 1, 0) + 1 for y, other in enumerate(there) if other == word}
            best = min([*([best] if best else []), *((-m, x - m + 1, y - m + 1) for y, m in run.items())], default=None)
        need = items.need[items.item == k][0]
        keep[i] = best is not None and -best[0] >= need
        if keep[i]:
            length[i], place[i], item_place[i] = -best[0], best[1], best[2]
    return tuple(x[keep] for x in (text, item, length, place, item_place))


def shard_matches(texts: pa.Array, items: Items) -> tuple[np.ndarray, ...]:
    """(text, item, words, place in text, place in item) of the longest match of each text with each item."""
    w = words(texts)
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if not len(w) or not len(items.start):
        return none
    seq, at, doc, vocabulary = number_words(w.hashes(), w.first)
    texts_n = len(w.first) - 1
    depth, most_need = int(items.room.max()), int(items.need.max())
    sa, keys = suffix_array(seq, most_need)
    # The items in the numbers of this shard; a word that it lacks gets a number of its own, which matches nothing.
    slot = np.searchsorted(vocabulary, items.hashes)
    known = vocabulary[np.minimum(slot, len(vocabulary) - 1)] == items.hashes
    numbers = np.where(known, slot + 1 + texts_n, seq.max() + 1 + np.arange(len(slot)))
    joined = np.concatenate([seq, numbers])
    prefixes = Prefixes(joined)
    _, take = first_keys(seq)
    bits = 62 // take
    query = items.start
    ok = np.ones(len(query), dtype=bool)
    key = np.zeros(len(query), dtype=np.int64)
    for j in range(take):
        place = np.minimum(query + j, len(numbers) - 1)
        ok &= known[place]
        key = (key << bits) | np.where(known[place], numbers[place], 0)
    query_no = np.flatnonzero(ok)
    low = np.searchsorted(keys, key[query_no], "left")
    high = np.searchsorted(keys, key[query_no], "right")
    some = high > low
    query_no, low, high = query_no[some], low[some], high[some]
    if not len(query_no):
        return none
    where = query[query_no] + len(seq)
    need = items.need[query_no]

    def bound(strict: bool) -> np.ndarray:
        """First place in the range whose suffix is not before (strict: is after) the suffixes that begin with the query's first words."""
        a, b = low.copy(), high.copy()
        while True:
            act = np.flatnonzero(a < b)
            if not len(act):
                return a
            mid = (a[act] + b[act]) // 2
            pos = sa[mid]
            same = np.minimum(prefixes.common(pos, where[act], most_need), need[act])
            full = same >= need[act]
            # Suffixes of a shard end in a separator, so the words to compare always exist on both sides.
            less = joined[np.minimum(pos + same, len(joined) - 1)] < joined[np.minimum(where[act] + same, len(joined) - 1)]
            go = np.where(full, strict, less)
            a[act[go]] = mid[go] + 1
            b[act[~go]] = mid[~go]

    first, last = bound(False), bound(True)
    hit = np.flatnonzero(last > first)
    query_no, first, last = query_no[hit], first[hit], last[hit]
    best = none
    for n in np.unique(items.need[query_no]).tolist():
        own = np.flatnonzero(items.need[query_no] == n)
        # Places that begin with the same n words are a group: one range of the suffix array, in text and items.
        heads, which, of = np.unique(first[own], return_index=True, return_inverse=True)
        size = last[own][which] - heads
        pos = sa[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(heads, size)]
        group = np.repeat(np.arange(len(heads)), size)
        group_at = np.full(len(seq) + 1, -2, dtype=np.int64)
        group_at[pos] = group
        of_at = np.full(len(numbers) + 1, -1, dtype=np.int64)
        of_at[query[query_no[own]]] = of
        begins = items.at[query_no[own]] == 0
        of_before = np.where(begins, -1, of_at[query[query_no[own]] - 1])
        for p, q in _beginnings(pos, group, group_at[pos - 1], query_no[own], of, of_before):
            length = np.minimum(prefixes.common(p, query[q] + len(seq), depth), items.room[q])
            found = doc[p], items.item[q], length, p - at[doc[p]], items.at[q]
            best = _best(*(np.concatenate(x) for x in zip(best, found)))
    return _verbatim(w, items, best)


def item_parts(bench: DataFrame, min_words: int, least_item: int, id_column: str = "item_id") -> Iterator[Items]:
    """The benchmark in parts of at most ``PART_BYTES`` bytes of text (one item may exceed it), one after the other."""
    if not 3 <= least_item <= min_words:
        raise ValueError("least_item must lie between 3 and min_words")
    rows = bench.where(F.col("text").isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    ids, texts, size = [], [], 0
    for r in rows.orderBy("id", "text").toLocalIterator():
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if ids and size + n > PART_BYTES:
            yield Items(ids, texts, min_words, least_item)
            ids, texts, size = [], [], 0
        ids.append(r["id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield Items(ids, texts, min_words, least_item)


def _sharded(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    def each(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # More than one where a column passes what one array can hold.
        for b in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield from fn(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for b in slices(whole, limit=SHARD_BYTES):
                held.append(b)
                size += b.nbytes
                if size >= SHARD_BYTES:
                    yield from each(held)
                    held, size = [], 0
        if held:
            yield from each(held)

    return run


def benchmark_matches(docs: DataFrame, bench: DataFrame, min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): the longest match of each affected document with each item, places counted in words from 0."""
    schema = "doc_id bigint, item_id bigint, match_words int, doc_word int, item_word int"
    names = [x.split()[0] for x in schema.split(", ")]
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    sent = docs.sparkSession.sparkContext
    for part in item_parts(bench, min_words, least_item):
        items = sent.broadcast(part)

        def matches(b: pa.RecordBatch, items=items) -> Iterator[pa.RecordBatch]:
            text, item, length, place, item_place = shard_matches(b.column("text"), items.value)
            if len(text):
                item_ids = pa.array(items.value.ids[item], mask=items.value.null[item])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(text)), item_ids, *(pa.array(x, pa.int32()) for x in (length, place, item_place))], names=names)

        found = found.unionAll(texts.mapInArrow(_sharded(matches), schema))
    best = F.struct(-F.col("match_words"), "doc_word", "item_word")
    # Items that share an id: one row each, with the longest match.  The rows are few; texts don't move.
    w = found.groupBy("doc_id", "item_id").agg(F.min(best).alias("m"))
    return w.select("doc_id", "item_id", (-F.col("m.col1")).alias("match_words"), "m.doc_word", "m.item_word")


def decontaminate(docs: DataFrame, bench: DataFrame, min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM) -> DataFrame:
    """The same columns, without the affected documents.  Needs no shuffle."""
    for part in item_parts(bench, min_words, least_item):
        items = docs.sparkSession.sparkContext.broadcast(part)

        def clean(b: pa.RecordBatch, items=items) -> Iterator[pa.RecordBatch]:
            keep = np.ones(b.num_rows, dtype=bool)
            keep[shard_matches(b.column("text"), items.value)[0]] = False
            yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(_sharded(clean), docs.schema)
    return docs


def oracle(min_words: int = MIN_WORDS, least_item: int = LEAST_ITEM) -> str:
    """The same matches by runs of equal n-grams along a diagonal."""
    toks = lambda t, k: f"SELECT {k} AS k, list_transform(regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x) AS w FROM {t} WHERE text IS NOT NULL"
    grams = "array_to_string(list_slice(w, i, i + n - 1), ' ')"
    return f"""
WITH d AS ({toks('documents', 'doc_id')}), b AS ({toks('benchmark', 'item_id')}),
bn AS (SELECT k, w, CASE WHEN len(w) >= {min_words} THEN {min_words} WHEN len(w) >= {least_item} THEN len(w) ELSE 0 END AS n FROM b),
bg AS (SELECT k, n, i, md5({grams}) AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn WHERE n > 0)),
dg AS (SELECT k, n, i, md5({grams}) AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bn WHERE n > 0) WHERE len(w) >= n)),
m AS (SELECT dg.k AS doc_id, bg.k AS item_id, bg.n AS n, dg.i AS di, bg.i AS bi FROM dg JOIN bg ON dg.n = bg.n AND dg.g = bg.g),
r AS (SELECT *, di - row_number() OVER (PARTITION BY doc_id, item_id, n, di - bi ORDER BY di) AS run FROM m),
s AS (SELECT doc_id, item_id, min(di) AS di, min(bi) AS bi, count(*) + any_value(n) - 1 AS len FROM r GROUP BY doc_id, item_id, n, di - bi, run),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len DESC, di, bi) AS nth FROM s)
SELECT doc_id, item_id, len::INT AS match_words, (di - 1)::INT AS doc_word, (bi - 1)::INT AS item_word FROM t WHERE nth = 1"""
