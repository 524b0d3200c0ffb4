"""Suffix-array dedup with longest-previous-factor arrays.

A passage of ``min_words`` words or more that occurred before, in the same or an earlier document, is removed; the
first occurrence stays.  Documents are ordered by (doc_id, text hash).

1. Every window of GRAM words is hashed and the least hash of each ``min_words - GRAM + 1`` neighbouring windows is
   taken as an anchor, so a passage of ``min_words`` words holds the same anchors wherever it stands.
2. Anchors that occur once anywhere can't be in a repeated passage.  Around each of the others the words that a passage
   of ``min_words`` words holding it may reach are cut out and sent to the task that owns the anchor: all
   suffixes that share their first ``min_words`` words meet there.
3. There a suffix array is built over the pieces.  Among suffixes with a common prefix of ``min_words`` words the
   previous and the next smaller text position in suffix order give the longest previous factor.
4. A piece reaches ``min_words`` words past its anchor, which cuts long factors short; every later suffix of a long repeat
   has its own factor, so their union is the whole repeat.  The spans are merged and cut from the text.

Pieces of one anchor with equal bytes go to the suffix array once: every factor of a later one is the
whole piece.  An anchor that more than ``hot`` pieces hold, such as one in a notice that a third of all documents carry, is split: each
``min_words`` words around it are a piece of their own, of which the first place is kept, and combined before the shuffle.

Words are runs of letters, digits and non-ASCII characters, compared exactly.  A removed word takes what follows it, up to the next
word, along.  Defined results: null texts stay null, empty ones empty; rows repeated whole are one document; null ids sort first;
a passage repeated inside one document loses its later copies, overlapping ones too; empty tables give empty ones;
other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bytewords import Words, slices, windows, words
from vellum.llm.common import HASH, ID, ROW, cut, keyed_texts, nested, same_document
from vellum.llm.suffixes import Prefixes, number_words, smaller_neighbours, suffix_array

MIN_WORDS, GRAM, BUFFER_BYTES, HOT, LISTED = 50, 16, 2 << 20, 20_000, 1 << 20
PIECES = f"anchor bigint, {ID} bigint, {HASH} bigint, start int, body binary"


def anchors(w: Words, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, word in the text) of the anchors of each text of at least ``min_words`` words."""
    value, at = windows(w.hashes(), w.first, gram)
    span = min_words - gram + 1
    doc = w.doc()
    owner = doc[at] if len(at) else at
    if len(value) < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    # The least of each `span` neighbours, by doubling.
    least, have = value.copy(), 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    inside = owner[: len(least)] == owner[span - 1 :]
    chosen = np.zeros(len(value), dtype=bool)
    # Every window that equals the least value of some neighbourhood; ties are all taken, so the choice depends on the words alone.
    reach = np.zeros(len(value), dtype=np.uint64)
    groups = np.flatnonzero(inside)
    if len(groups):
        top = np.where(inside, least, np.uint64(0))
        # The largest neighbourhood minimum over the neighbourhoods that hold the window: it is chosen if that equals its value.
        padded = np.concatenate([np.zeros(span - 1, dtype=np.uint64), top, np.zeros(span - 1, dtype=np.uint64)])
        most, have = padded, 1
        while have < span:
            step = min(have, span - have)
            most = np.maximum(most[: len(most) - step], most[step:])
            have += step
        reach = most[: len(value)]
        chosen = reach == value
    pick = np.flatnonzero(chosen)
    return value[pick].view(np.int64), owner[pick], at[pick] - w.first[owner[pick]]


def _anchor_rows(min_words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                value, text, word = anchors(words(b.column("text"), lower=False), min_words, gram)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column(ID).take(take), b.column(HASH).take(take), pa.array(value), pa.array(word, pa.int32())], names=[ID, HASH, "anchor", "word"])

    return run


def _piece_rows(min_words: int, gram: int):
    """Cuts the piece around each listed anchor; ``lead`` is the number of its words that stand before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, limit=2 << 20):
                w = words(b.column("text"), lower=False)
                lists = b.column("found")
                found = lists.flatten()
                doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                anchor, word = (found.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "word"))
                at = w.first[doc] + word
                a = np.maximum(at - (min_words - gram), w.first[doc])
                z = np.minimum(at + min_words, w.first[doc + 1])
                data = w.data.tobytes()
                for x in range(0, len(doc), 10000):
                    s = slice(x, x + 10000)
                    bodies = [data[i:j] for i, j in zip(w.start[a[s]].tolist(), w.end[z[s] - 1].tolist())]
                    take = pa.array(doc[s])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[s]), b.column(ID).take(take), b.column(HASH).take(take), pa.array((a[s] - w.first[doc[s]]), pa.int32()), pa.array(bodies, pa.binary())], names=["anchor", ID, HASH, "start", "body"])

    return run


def factors(rows: list[tuple], min_words: int) -> tuple[list[tuple], list]:
    """rows: (id, hash, first word, body).  (row, first word, words, id of the first copy) of the merged factors of each
    row, and for each row the id of the first copy of its first ``min_words`` words."""
    w = words(pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()), lower=False)
    seq, at, piece, _ = number_words(w.hashes(), w.first)
    # Text order: (null ids first, id, hash, word).  Pieces of one document that overlap give the same place twice.
    docs = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows})
    number = {d: i for i, d in enumerate(docs)}
    doc = np.array([number[(r[0] is not None, r[0] or 0, r[1])] for r in rows], dtype=np.int64)
    start = np.array([r[2] for r in rows], dtype=np.int64)
    place = (doc[piece] << 32) | (start[piece] + np.arange(len(seq)) - at[piece])
    sa, _ = suffix_array(seq, min_words)
    prefixes = Prefixes(seq)
    same = np.zeros(len(sa), dtype=bool)
    same[1:] = prefixes.common(sa[1:], sa[:-1], min_words) >= min_words
    group = np.cumsum(~same)
    many = np.flatnonzero(np.isin(group, group[same]))
    origin = [r[0] for r in rows]
    if not len(many):
        return [], origin
    sa, group = sa[many], group[many]
    value = place[sa]
    before, after = smaller_neighbours(value, group)
    most = int(np.diff(w.first).max())
    size = np.zeros(len(sa), dtype=np.int64)
    for other in (before, after):
        has = np.flatnonzero(other >= 0)
        size[has] = np.maximum(size[has], prefixes.common(sa[has], sa[other[has]], most))
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(value, heads)
    first = np.repeat(least, np.diff(np.append(heads, len(sa)))) >> 32
    for i in np.flatnonzero(at[piece[sa]] == sa).tolist():
        origin[piece[sa[i]]] = docs[first[i]][1] if docs[first[i]][0] else None
    hit = np.flatnonzero(size >= min_words)
    row, word, size, first = piece[sa[hit]], (value[hit] & 0xFFFFFFFF), size[hit], first[hit]
    order = np.lexsort((word, row))
    out: list[list] = []
    for r, a, n, f in zip(*(x[order].tolist() for x in (row, word, size, first))):
        if out and out[-1][0] == r and a <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], a + n - out[-1][1])
        else:
            out.append([r, a, n, docs[f][1] if docs[f][0] else None])
    return [tuple(x) for x in out], origin


def _spans(min_words: int):
    """From pieces sorted by (anchor, id, hash, start): spans that occurred before."""

    def flush(rows: list[tuple], same: list[tuple]) -> Iterator[pa.RecordBatch]:
        spans, origin = factors(rows, min_words)
        found = [(*rows[r][:2], a, n, f) for r, a, n, f in spans] + [(*x[:4], origin[x[4]]) for x in same]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=[ID, HASH, "start", "n", "source"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        same: list[tuple] = []
        seen: dict[bytes, tuple] = {}
        last, size = None, 0
        for b in batches:
            for anchor, i, h, start, body in zip(*(b.column(n).to_pylist() for n in ("anchor", ID, HASH, "start", "body"))):
                if anchor != last:
                    if size > BUFFER_BYTES or len(same) > 20000:
                        yield from flush(rows, same)
                        rows, same, size = [], [], 0
                    last, seen = anchor, {}
                known = seen.get(body)
                if known is None:
                    seen[body] = (i, h, start, None, len(rows))
                    rows.append((i, h, start, body))
                    size += len(body)
                elif known[:3] != (i, h, start):  # else a row repeated whole
                    n = known[3]
                    if n is None:
                        n = len(words(pa.array([body.decode()]), lower=False))
                        seen[body] = (*known[:3], n, known[4])
                    if n >= min_words:
                        same.append((i, h, start, n, known[4]))
        if rows:
            yield from flush(rows, same)

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, hash, spans): of each document that repeats a passage, the merged word spans that occurred before, with the first copy's doc_id."""
    if not 0 < gram <= min_words:
        raise ValueError("gram must lie between 1 and min_words")
    return _spans_in(keyed_texts(docs).where("text is not null"), min_words, gram, hot)


def _listed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(id, hash, text, found): the texts with the anchors listed for them."""
    shared = found.groupBy(ID, HASH).agg(F.collect_set(F.struct("anchor", "word")).alias("found"))
    return texts.join(shared.hint("shuffle_hash"), same_document(texts, shared)).select(texts[ID], texts[HASH], "text", "found")


def _spans_in(texts: DataFrame, min_words: int, gram: int, hot: int, listed: int = LISTED) -> DataFrame:
    found = texts.select(ID, HASH, "text").mapInArrow(_anchor_rows(min_words, gram), f"{ID} bigint, {HASH} bigint, anchor bigint, word int")
    many = cut(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    pieces = _listed(texts, found.join(many.where(F.col("n") <= hot), "anchor", "left_semi")).mapInArrow(_piece_rows(min_words, gram), PIECES)
    met = pieces.repartition("anchor").sortWithinPartitions("anchor", ID, HASH, "start")
    spans = met.mapInArrow(_spans(min_words), f"{ID} bigint, {HASH} bigint, start int, n int, source bigint")
    boiler = many.where(F.col("n") > hot).select("anchor")
    if not boiler.isEmpty():
        spans = spans.unionByName(_hot_spans(texts.select(ID, HASH, "text"), boiler, min_words, gram, listed))
    grouped = spans.groupBy(ID, HASH).agg(F.array_sort(F.collect_set(F.struct("start", "n", "source"))).alias("spans"))
    return grouped.mapInArrow(_merge, f"{ID} bigint, {HASH} bigint, spans array<struct<start:int,n:int,source:bigint>>")


def _hot_spans(texts: DataFrame, boiler: DataFrame, min_words: int, gram: int, listed: int) -> DataFrame:
    """The spans of anchors that too many pieces hold for one task: each ``min_words`` words around such an anchor are a piece of their own.

    Texts don't move.  The anchors, and then the hashes of the pieces that occur twice, go to the tasks as lists while they are few
    (a hot anchor has very many pieces, so there are few of them), and are joined beyond that.  Bodies are combined before the shuffle:
    what is kept of each is its first place.
    """
    place = F.struct(ID, HASH, "start")
    narrow = f"anchor bigint, {ID} bigint, {HASH} bigint, start int"

    def pieces(wanted: DataFrame | None, bodies: bool) -> DataFrame:
        some = [_list(x, listed) if x is not None else None for x in (boiler, wanted)]
        found = texts.mapInArrow(_window_rows(min_words, gram, *some, bodies), f"of bigint, {PIECES if bodies else narrow}")
        if some[0] is None:
            found = found.join(boiler.select(F.col("anchor").alias("of")), "of", "left_semi")
        if wanted is not None and some[1] is None:
            found = found.join(wanted, "anchor", "left_semi")
        return found.drop("of")

    # A piece that holds two hot anchors comes twice, from one place.
    counted = pieces(None, False).groupBy("anchor").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    twice = cut(counted.select("anchor"))
    first = cut(pieces(twice, True).groupBy("anchor", "body").agg(F.min(place).alias("first")))
    kinds = first.groupBy("anchor").agg(F.count("*").alias("bodies"), F.min("first").alias("first"))
    few = first.count() <= listed
    if kinds.where("bodies > 1").isEmpty():
        later = pieces(twice, False).join(F.broadcast(kinds) if few else kinds, "anchor")
    else:  # hashes that deceive
        later = pieces(twice, True).join(F.broadcast(first) if few else first, ["anchor", "body"])
    return later.where(place > F.col("first")).select(ID, HASH, "start", F.lit(min_words).alias("n"), F.col("first")[ID].alias("source")).distinct()


def _list(df: DataFrame, most: int) -> np.ndarray | None:
    """The values of a column of numbers, in order; None where there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    return np.array(sorted(r[0] for r in rows), dtype=np.int64) if len(rows) <= most else None


def _among(x: np.ndarray, some: np.ndarray | None) -> np.ndarray:
    if some is None:
        return np.ones(len(x), dtype=bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), dtype=bool)


def _window_rows(min_words: int, gram: int, of: np.ndarray | None, wanted: np.ndarray | None, bodies: bool):
    """(anchor, hash of the window, id, hash, first word[, body]) of all windows of ``min_words`` words around the anchors ``of``, as far as their hashes are ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                w = words(b.column("text"), lower=False)
                anchor, doc, word = anchors(w, min_words, gram)
                hit = _among(anchor, of)
                anchor, doc, word = anchor[hit], doc[hit], word[hit]
                at = w.first[doc] + word
                low = np.maximum(at - (min_words - gram), w.first[doc])
                n = np.maximum(np.minimum(at, w.first[doc + 1] - min_words) - low + 1, 0)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                doc, anchor = np.repeat(doc, n), np.repeat(anchor, n)
                if not len(at):
                    continue
                value, where = windows(w.hashes(), w.first, min_words)
                value = value[np.searchsorted(where, at)].view(np.int64)
                hit = _among(value, wanted)
                at, doc, anchor, value = at[hit], doc[hit], anchor[hit], value[hit]
                data = w.data.tobytes() if bodies else b""
                for x in range(0, len(doc), 10000):
                    s = slice(x, x + 10000)
                    take = pa.array(doc[s])
                    cols = [pa.array(anchor[s]), pa.array(value[s]), b.column(ID).take(take), b.column(HASH).take(take), pa.array(at[s] - w.first[doc[s]], pa.int32())]
                    if bodies:
                        cols.append(pa.array([data[i:j] for i, j in zip(w.start[at[s]].tolist(), w.end[at[s] + min_words - 1].tolist())], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=["of", "anchor", ID, HASH, "start", "body"][: len(cols)])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins spans that touch; the source of a joined span is that of its first part, the least where several start there."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("source", pa.int64())]))
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            done: list[dict] = []
            for s in spans:
                if done and s["start"] <= done[-1]["start"] + done[-1]["n"]:
                    top = done[-1]
                    if s["start"] == top["start"] and (s["source"] is None or top["source"] is not None and s["source"] < top["source"]):
                        top["source"] = s["source"]
                    top["n"] = max(top["n"], s["start"] + s["n"] - top["start"])
                else:
                    done.append(dict(s))
            out.append(done)
        yield pa.RecordBatch.from_arrays([b.column(ID), b.column(HASH), pa.array(out, kind)], names=[ID, HASH, "spans"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            w = words(b.column("text"), lower=False)
            data, texts = w.data.tobytes(), []
            for d, spans in enumerate(b.column("spans").to_pylist()):
                first, end = int(w.first[d]), int(w.first[d + 1])
                keep, at = [], int(w.text_at[d])
                for s in spans:
                    a, z = first + s["start"], first + s["start"] + s["n"]
                    keep.append(data[at : int(w.start[a])])
                    at = int(w.start[z]) if z < end else int(w.text_at[d + 1])
                keep.append(data[at : int(w.text_at[d + 1])])
                texts.append(b"".join(keep).decode())
            yield pa.RecordBatch.from_arrays([b.column(ID), b.column(HASH), b.column("spans"), pa.array(texts, pa.string())], names=[ID, HASH, "spans", "text"])


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, hash, spans, text) of the documents that repeat a passage, text without it."""
    # Both joins with the texts shuffle them in the same way, so Spark does it once.
    texts = keyed_texts(docs).where("text is not null")
    spans = _spans_in(texts, min_words, gram, hot)
    both = texts.join(spans.hint("shuffle_hash"), same_document(texts, spans)).select(texts[ID], texts[HASH], "text", "spans")
    return both.mapInArrow(_cut_rows, f"{ID} bigint, {HASH} bigint, spans array<struct<start:int,n:int,source:bigint>>, text string")


def removed_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, source_doc_id, n_spans, removed_words, text) of each document that repeats a passage: the first copy's document for its first span, and the text that stays."""
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["n"])
    return cleaned(docs, min_words, gram, hot).select(F.col(ID).alias("doc_id"), F.get("spans", F.lit(0))["source"].alias("source_doc_id"), F.size("spans").alias("n_spans"), total.alias("removed_words"), "text")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """All rows and columns, ``text`` without later copies."""
    new = cut(cleaned(docs, min_words, gram, hot).select(ID, HASH, F.col("text").alias("new")).dropDuplicates([ID, HASH]))
    rows = nested(docs)
    both = rows.join(new.hint("shuffle_hash"), same_document(rows, new), "left").select(rows[ROW], "new")
    return both.select(F.col(ROW).withField("text", F.coalesce("new", f"{ROW}.text")).alias(ROW)).select(f"{ROW}.*")


def oracle(min_words: int = MIN_WORDS) -> str:
    word, rest = "[a-zA-Z0-9\\x{80}-\\x{10FFFF}]+", "[^a-zA-Z0-9\\x{80}-\\x{10FFFF}]*"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract(text, '^{rest}') AS lead, regexp_extract_all(text, '{word}') AS w, regexp_extract_all(text, '{word}{rest}') AS p FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {min_words - 1}), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {min_words} + 2)) AS i FROM t WHERE len(w) >= {min_words})),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth, first_value(doc_id) OVER (PARTITION BY g ORDER BY doc_id, i) AS source FROM g),
r AS (SELECT doc_id, i, source, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {min_words} THEN 0 ELSE 1 END AS fresh FROM f WHERE nth > 1),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r),
u AS (SELECT doc_id, span, min(i) AS a, max(i) + {min_words} AS z, min_by(source, i) AS source FROM s GROUP BY doc_id, span),
x AS (SELECT t.doc_id, t.lead, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM t WHERE doc_id IN (SELECT doc_id FROM u)),
k AS (SELECT x.doc_id, string_agg(x.piece, '' ORDER BY x.i) AS body FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = x.doc_id AND x.i >= u.a AND x.i < u.z) GROUP BY x.doc_id),
n AS (SELECT doc_id, min_by(source, a) AS source_doc_id, count(*)::INT AS n_spans, sum(z - a)::BIGINT AS removed_words FROM u GROUP BY doc_id)
SELECT n.doc_id, source_doc_id, n_spans, removed_words, t.lead || coalesce(k.body, '') AS text FROM n JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""
