"""Tokens of the standard analyzer counted and sought in the bytes of Arrow batches.

Cutting a text into an array of words costs hundreds of nanoseconds a word, wanted or not.  Here words are numbers in numpy arrays: a word's first
eight bytes are one of 64 bits, and no stop word is longer.  Texts are worked on a block at a time, so memory is bounded by the block or the longest text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Searches run where workers can't import this package, too.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 18
FOUND = "array<struct<tokens:array<struct<term:string,position:int>>,length:int>>"
_FOUND = pa.list_(pa.struct([("tokens", pa.list_(pa.struct([("term", pa.string()), ("position", pa.int32())]))), ("length", pa.int32())]))
#: The lowercase byte of a word's byte, 0 for all others.
LOWER = np.zeros(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    LOWER[_c] = LOWER[ord(chr(_c).upper())] = _c
#: What is kept of eight bytes by a word of each length.
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def head(word: bytes) -> int:
    """The first eight bytes as a number."""
    return int.from_bytes(word[:8], "little")


class Heads:
    """Some numbers, to be found in an array.  A table of hashes sorts out most others first."""

    MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)

    def __init__(self, heads: Iterable[int]) -> None:
        self.sorted = np.array(sorted(set(heads)), dtype=np.uint64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.sorted * self.MIX >> self.SHIFT] = True

    def __len__(self) -> int:
        return len(self.sorted)

    def __reduce__(self) -> tuple:
        return Heads, (self.sorted.tolist(),)  # the table is made where it is used

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in x of those that are one, and which."""
        at = np.flatnonzero(self.maybe[x * self.MIX >> self.SHIFT])
        which = np.searchsorted(self.sorted, x[at])
        same = self.sorted[np.minimum(which, len(self) - 1)] == x[at] if len(self) else np.zeros(0, dtype=bool)
        return at[same], which[same]


@dataclass
class Words:
    """The words of a block: ``first[d]:first[d + 1]`` are those of text d; ``kept`` says which are tokens, ``sums`` how many stand before each."""

    low: np.ndarray
    start: np.ndarray
    size: np.ndarray
    head: np.ndarray
    first: np.ndarray
    kept: np.ndarray
    sums: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.sums[self.first]).astype(np.int32)


def _words(data: np.ndarray, edges: np.ndarray, stops: Heads) -> Words:
    n = len(data)
    low = np.zeros(n + 8, dtype=np.uint8)
    np.take(LOWER, data, out=low[:n], mode="clip")
    word = low[:n] != 0
    inner = edges[(edges > 0) & (edges < n)]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[inner] = after[inner - 1] = False
    start = np.flatnonzero(word & ~before)
    size = np.flatnonzero(word & ~after) + 1 - start
    eight = np.ndarray((n,), dtype="<u8", buffer=low, strides=(1,))
    heads = eight[start] & MASK[np.minimum(size, 8)]
    kept = size >= 2
    short = np.flatnonzero(kept & (size <= 8))
    kept[short[stops.find(heads[short])[0]]] = False
    sums = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(kept, out=sums[1:])
    return Words(low, start, size, heads, np.searchsorted(start, edges), kept, sums)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where texts begin and end, and their bytes."""
    _, where, data = texts.buffers()
    edges = np.frombuffer(where, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return edges - edges[0], data[edges[0] : edges[-1]]


def _blocks(texts: pa.Array, stops: Heads) -> Iterator[Words]:
    if not len(texts):
        return
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    edges, data = _bytes(texts)
    # Of all characters but ASCII letters two have a lowercase form that holds one.
    whole = data.tobytes()
    for old, new in (("\u212a", "k"), ("\u0130", "i\u0307")):
        if old.encode() in whole:
            texts = pc.replace_substring(texts, old, new)
            edges, data = _bytes(texts)
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(edges, edges[a] + BLOCK, side="right")) - 1)
        yield _words(data[edges[a] : edges[z]], edges[a : z + 1] - edges[a], stops)
        a = z


def counted(texts: pa.Array, stops: Heads) -> pa.Array:
    """The number of each text's tokens."""
    return pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *[w.counts() for w in _blocks(texts, stops)]]))


class Finder:
    """Finds the tokens that are one of some terms."""

    def __init__(self, terms: Iterable[str], stop_words: Iterable[str]) -> None:
        self.stops = Heads(head(w.encode()) for w in stop_words)
        terms = [t.encode() for t in terms if re.fullmatch("[a-z0-9_]{2,}", t)]
        self.short = Heads(head(t) for t in terms if len(t) <= 8)
        self.long = Heads(head(t) for t in terms if len(t) > 8)
        # The terms of eight bytes or less by their place in ``short``, then the others.
        self.terms = [int(h).to_bytes(8, "little").rstrip(b"\0") for h in self.short.sorted]
        self.number = {t: i for i, t in enumerate(sorted({t for t in terms if len(t) > 8}), len(self.terms))}
        self.terms = pa.array([t.decode() for t in [*self.terms, *self.number]], pa.string())

    def _which(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The words found, in order, and the number of the term of each."""
        term = np.full(len(w.start), -1, dtype=np.int64)
        if len(self.short):
            at = np.flatnonzero(w.kept & (w.size <= 8))
            found, which = self.short.find(w.head[at])
            term[at[found]] = which
        if len(self.long):
            at = np.flatnonzero(w.size > 8)
            at = at[self.long.find(w.head[at])[0]]
            term[at] = [self.number.get(w.low[s : s + n].tobytes(), -1) for s, n in zip(w.start[at].tolist(), w.size[at].tolist())]
        at = np.flatnonzero(term >= 0)
        return at, term[at]

    def find(self, texts: pa.Array) -> pa.Array:
        """For each text its found tokens and the number of all, or nothing where none is found."""
        has, length, inside, terms, places = ([np.zeros(0, dtype=np.int32)] for _ in range(5))
        for w in _blocks(texts, self.stops):
            at, term = self._which(w)
            cut = np.searchsorted(at, w.first)
            n = np.diff(cut).astype(np.int32)
            has.append((n > 0).astype(np.int32))
            length.append(w.counts()[n > 0])
            inside.append(n[n > 0])
            terms.append(term.astype(np.int32))
            places.append((at + 1 - np.repeat(w.first[:-1], n)).astype(np.int32))
        offsets = lambda sizes: pa.array(np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(np.concatenate(sizes), dtype=np.int32)]))
        inner, outer = _FOUND.value_type[0].type.value_type, _FOUND.value_type
        toks = pa.StructArray.from_arrays([self.terms.take(pa.array(np.concatenate(terms))), pa.array(np.concatenate(places))], fields=list(inner))
        rows = pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets(inside), toks), pa.array(np.concatenate(length))], fields=list(outer))
        return pa.ListArray.from_arrays(offsets(has), rows)


def count(text: Column, stop_words: tuple[str, ...]) -> Column:
    stops = Heads(head(w.encode()) for w in stop_words)

    def run(texts: pa.Array) -> pa.Array:
        return counted(texts, stops)

    return F.arrow_udf(run, "int")(text)


def find(text: Column, terms: tuple[str, ...], stop_words: tuple[str, ...]) -> Column:
    finder = Finder(terms, stop_words)

    def run(texts: pa.Array) -> pa.Array:
        return finder.find(texts)

    return F.arrow_udf(run, FOUND)(text)
