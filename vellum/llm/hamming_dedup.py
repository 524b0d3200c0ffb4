"""MinHash near-dedup by a multi-index Hamming join.

Each document gets 64 MinHash values of its word pairs, cut to b = 16 bits; the distance of two signatures is
the number of places where they differ.  A signature is split into 16 chunks of 4 places.  Two signatures at
distance <= 23 must, by the pigeonhole principle over the allowances (a_i + 1), have a chunk whose errors
stay within its allowance: eight chunks allow one error, eight allow none, and 8*2 + 8*1 = 24 > 23.  All
errors a chunk may have are enumerated by leaving out each place in turn, so equal keys nominate every pair
under the threshold, with no cap; the distance of nominated signatures is then counted exactly.

Equal signatures are collapsed first.  Inside a bucket a breadth-first search compares each reached
signature with the unreached ones only, which finds the exact connected parts in near-linear time for tight groups.  Buckets of more than
``hot`` signatures are compared with their least one first, and unless all are near it, split by the keys of a second chunk.
Connected components over all buckets are the groups; the document with the lowest (doc_id, text hash) stays.

Defined results: null, empty and wordless texts have no signature and always stay; a one-word text is
represented by its word; rows repeated whole are one document and stay or go together; null ids sort first; empty
tables give empty tables; other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bytewords import Words, mix, slices, windows, words
from vellum.llm.common import HASH, ID, ROW, cut, keyed_texts, nested, same_document

PLACES, CHUNK, LIMIT, HOT = 64, 4, 23, 20_000
_rng = np.random.default_rng(20240501)
_A = (_rng.integers(1, 1 << 32, PLACES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, PLACES, dtype=np.uint64).astype(np.uint32)


def allowances(places: int = PLACES, chunk: int = CHUNK, limit: int = LIMIT) -> list[int]:
    """Errors allowed in each chunk, so that the sum of (allowance + 1) exceeds the limit."""
    n = places // chunk
    allow = [(limit + 1) // n - 1 + (i < (limit + 1) % n) for i in range(n)]
    if min(allow) < 0 or max(allow) > 1:
        raise ValueError("this layout allows no or more than one error in a chunk")
    return allow


def features(w: Words, grams: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word pairs of each text (the word itself where there is but one), and where each text's start."""
    h = w.hashes()
    got, at = windows(h, w.first, grams)
    doc = w.doc()
    counts = np.diff(w.first)
    short = np.flatnonzero(np.isin(doc, np.flatnonzero((counts > 0) & (counts < grams)))) if len(doc) else at[:0]
    owner = np.concatenate([doc[at], doc[short]])
    value = np.concatenate([got, h[short]])
    order = np.argsort(owner, kind="stable")
    return value[order], np.searchsorted(owner[order], np.arange(len(counts) + 1))


def minhash(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(texts, PLACES) uint16 signatures of the texts that have a word, and the numbers of these texts."""
    value, first = features(w)
    has = np.flatnonzero(np.diff(first))
    out = np.empty((len(has), PLACES), dtype=np.uint16)
    if len(has):
        x = (value >> np.uint64(32)).astype(np.uint32)
        at = first[:-1][has]
        for j in range(PLACES):
            least = np.minimum.reduceat(x * _A[j] + _B[j], at)
            out[:, j] = (mix(least.astype(np.uint64) + np.uint64(j << 40)) >> np.uint64(20)).astype(np.uint16)
    return out, has


def chunk_keys(sig: np.ndarray, chunk: int = CHUNK, limit: int = LIMIT) -> np.ndarray:
    """(signatures, keys) int64: each chunk whole, or with each place left out in turn where it may hold an error."""
    cols, n = [], 0
    for c, allowed in enumerate(allowances(sig.shape[1], chunk, limit)):
        part = sig[:, c * chunk : (c + 1) * chunk].astype(np.uint64)
        for skip in range(chunk) if allowed else (None,):
            key = np.full(len(sig), 1 + n, dtype=np.uint64)
            for p in range(chunk):
                if p != skip:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, p])
            cols.append(key.view(np.int64))
            n += 1
    return np.stack(cols, axis=1) if cols else np.zeros((len(sig), 0), np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(id, hash, sig binary) of every document that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sig, has = minhash(words(batch.column("text")))
                take = pa.array(has)
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * PLACES), len(has), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary()) if len(has) else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(ID).take(take), batch.column(HASH).take(take), blob], names=[ID, HASH, "sig"])

    return keyed_texts(docs).mapInArrow(run, f"{ID} bigint, {HASH} bigint, sig binary")


def _matrix(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.uint16).reshape(len(blobs), -1)


def _forest(sig: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of signatures at most ``limit`` apart."""
    left, edges = np.arange(len(sig)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = (sig[left] != sig[u]).sum(axis=1) <= limit
            found = left[near]
            edges += [(u, v) for v in found.tolist()]
            queue += found.tolist()
            left = left[~near]
    return edges


def _all(sig: np.ndarray, limit: int) -> list[tuple[int, int]]:
    return [(u, u + 1 + v) for u in range(len(sig) - 1) for v in np.flatnonzero((sig[u + 1 :] != sig[u]).sum(axis=1) <= limit).tolist()]


def _flush_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of rows sorted by ``key``, put together so that no key is in two tables; each row is copied once."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        cuts = np.flatnonzero(np.diff(key)) + 1
        cut_at = int(cuts[-1]) if len(cuts) else 0
        if cut_at:
            yield pa.Table.from_batches([*held, b.slice(0, cut_at)])
            held = [b.slice(cut_at)]
        elif held and key[0] != last:
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _compare(pick, limit: int):
    """Edges inside the buckets of rows (key, id, hash, sig) sorted by key."""

    def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, sig = t.column("key").to_numpy(), _matrix(t.column("sig"))
        first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        size = np.diff(first)
        two = first[:-1][size == 2]
        near = two[(sig[two] != sig[two + 1]).sum(axis=1) <= limit]
        a, b = near.tolist(), (near + 1).tolist()
        for at, n in zip(first[:-1][size > 2].tolist(), size[size > 2].tolist()):
            for u, v in pick(sig[at : at + n], limit):
                a.append(at + int(u))
                b.append(at + int(v))
        if a:
            ids, hashes = t.column("id").combine_chunks(), t.column("hash").combine_chunks()
            yield pa.RecordBatch.from_arrays([x.take(pa.array(i)) for i in (a, b) for x in (ids, hashes)], names=["a_id", "a_hash", "b_id", "b_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _flush_by_key(batches):
            yield from pairs_of(t.combine_chunks())

    return run


EDGES = "a_id bigint, a_hash bigint, b_id bigint, b_hash bigint"


def _inside(shared: DataFrame, flat: DataFrame, pick, limit: int) -> DataFrame:
    """Edges inside the buckets of (key, id, hash)."""
    carried = shared.alias("s").join(flat.alias("f"), F.expr("s.id <=> f.id AND s.hash = f.hash")).select("s.key", "s.id", "s.hash", "f.sig")
    return carried.repartition("key").sortWithinPartitions("key", "id", "hash").mapInArrow(_compare(pick, limit), EDGES)


def second_keys(sig: np.ndarray, key: np.ndarray, chunk: int = CHUNK, limit: int = LIMIT) -> np.ndarray:
    """(rows, keys): for each row, which is in the bucket ``key``, that key together with each key of the chunks that it doesn't come from.

    Two signatures of a bucket are at most ``limit`` apart in the other chunks too, so the pigeonhole principle holds among those.
    """
    places = sig.shape[1]
    owner = np.repeat(np.arange(places // chunk), [chunk if a else 1 for a in allowances(places, chunk, limit)])
    of = owner[(chunk_keys(sig, chunk, limit) == key[:, None]).argmax(axis=1)]
    rest = np.arange(places - chunk)[None, :] + np.where(np.arange(places - chunk)[None, :] >= of[:, None] * chunk, chunk, 0)
    more = chunk_keys(np.take_along_axis(sig, rest, axis=1), chunk, limit)
    return mix(mix(key.view(np.uint64))[:, None] + more.view(np.uint64)).view(np.int64)


def _hot_edges(shared: DataFrame, flat: DataFrame, limit: int) -> DataFrame:
    """Edges inside buckets that are too large for one task.

    Each signature is compared with the least one of its bucket.  Where all are near that one, they are connected and the bucket is done.
    The others are split by the keys of a second chunk; parts whose signatures are all near the least one are left out.
    """
    carried = shared.alias("s").join(flat.alias("f"), F.expr("s.id <=> f.id AND s.hash = f.hash")).select("s.key", "s.id", "s.hash", "f.sig")
    # Combined before the shuffle.
    least = carried.groupBy("key").agg(F.min(F.struct("id", "hash", "sig")).alias("to"))
    beside = carried.join(least, "key").select("key", "id", "hash", "sig", F.col("to.id").alias("to_id"), F.col("to.hash").alias("to_hash"), F.col("to.sig").alias("to_sig"))

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_matrix(b.column("sig")) != _matrix(b.column("to_sig"))).sum(axis=1) <= limit if b.num_rows else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("key", "id", "hash", "sig", "to_id", "to_hash")), pa.array(near)], names=["key", "id", "hash", "sig", "to_id", "to_hash", "near"])

    known = cut(beside.mapInArrow(distance, "key bigint, id bigint, hash bigint, sig binary, to_id bigint, to_hash bigint, near boolean"))
    star = known.where("near").select(F.col("to_id").alias("a_id"), F.col("to_hash").alias("a_hash"), F.col("id").alias("b_id"), F.col("hash").alias("b_hash"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                s = b.slice(at, 2000)
                keys = second_keys(_matrix(s.column("sig")), s.column("key").to_numpy(), CHUNK, limit)
                take = pa.array(np.repeat(np.arange(s.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(s.column(n).take(take) for n in ("id", "hash", "near"))], names=["key", "id", "hash", "near"])

    open_keys = known.where("not near").select("key").distinct()
    parts = known.join(open_keys, "key", "left_semi").select("key", "id", "hash", "sig", "near").mapInArrow(second, "key bigint, id bigint, hash bigint, near boolean")
    wanted = parts.groupBy("key").agg(F.count("*").alias("n"), F.min("near").alias("near")).where("n > 1 and not near").select("key")
    return star.unionAll(_inside(parts.join(wanted, "key", "left_semi").select("key", "id", "hash"), flat, _forest, limit))


def near_edges(sigs: DataFrame, limit: int = LIMIT, all_pairs: bool = False, hot: int = HOT) -> DataFrame:
    """(a, b) over distinct signatures (node, sig): every pair at distance <= limit, or edges that connect what such pairs connect."""

    def explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = chunk_keys(_matrix(b.column("sig")), CHUNK, limit) if b.num_rows else np.zeros((0, 0), np.int64)
            n = keys.shape[1]
            for a in range(0, b.num_rows, 2000):
                some = keys[a : a + 2000]
                take = pa.array(np.repeat(np.arange(a, a + len(some)), n))
                yield pa.RecordBatch.from_arrays([pa.array(some.ravel()), b.column("id").take(take), b.column("hash").take(take)], names=["key", "id", "hash"])

    flat = sigs.select("node.id", "node.hash", "sig")
    keys = flat.mapInArrow(explode_keys, "key bigint, id bigint, hash bigint")
    many = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    most = many.where(F.col("n") > hot).select("key")
    if all_pairs or most.isEmpty():
        found = _inside(keys.join(many.select("key"), "key", "left_semi"), flat, _all if all_pairs else _forest, limit)
    else:
        found = _inside(keys.join(many.where(F.col("n") <= hot).select("key"), "key", "left_semi"), flat, _forest, limit)
        found = found.unionAll(_hot_edges(keys.join(most, "key", "left_semi"), flat, limit))
    a, b = F.struct(F.col("a_id").alias("id"), F.col("a_hash").alias("hash")), F.struct(F.col("b_id").alias("id"), F.col("b_hash").alias("hash"))
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that isn't the least of its connected component; root is that least node.

    Large-star and small-star steps alternate until the edges stay the same; each round is written to the shared folder.
    """
    edges = cut(edges.select("a", "b").where("a <> b"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    last, now = None, mark(edges)
    while now != last and now[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # large: m < b.  Small star: every b sends its other smaller neighbours, and itself, to its least one.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x <> y").unionAll(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        edges = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        last, now = now, mark(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_groups(docs: DataFrame, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """(doc_id, hash, keeper_doc_id, keeper_hash, group_size) of the documents that go."""
    sigs = cut(signatures(docs))
    node = F.struct("id", "hash")
    distinct = cut(sigs.groupBy("sig").agg(F.min(node).alias("node")))
    roots = components(near_edges(distinct, limit, hot=hot))
    rep = distinct.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("keeper"))
    member = sigs.join(rep, "sig").select(node.alias("me"), "keeper")
    sizes = member.groupBy("keeper").agg(F.countDistinct("me").alias("group_size")).where("group_size > 1")
    gone = member.join(sizes, "keeper").where("me <> keeper").distinct()
    return gone.select(F.col("me.id").alias("doc_id"), F.col("me.hash").alias("hash"), F.col("keeper.id").alias("keeper_doc_id"), F.col("keeper.hash").alias("keeper_hash"), "group_size")


def near_dedup(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The same columns; of each group of near duplicates one document stays."""
    gone = near_groups(docs, limit).select(F.col("doc_id").alias(ID), HASH)
    rows = nested(docs)
    return rows.join(gone.hint("shuffle_hash"), same_document(rows, gone), "left_anti").select(f"{ROW}.*")
