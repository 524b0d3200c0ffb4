"""Suffix arrays over word numbers, in numpy."""

from __future__ import annotations

import numpy as np

from vellum.llm.bytewords import _Q, _QI, mix, powers


def number_words(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One sequence of all texts, each closed by a separator of its own so that no match runs past a text's end.

    Returns the sequence (separators get 1..texts, words the numbers after that), the position of each
    text's first word in it, the text at each position, and the sorted distinct word hashes.
    """
    texts = len(first) - 1
    vocabulary, number = np.unique(hashes, return_inverse=True)
    doc = np.repeat(np.arange(texts), np.diff(first) + 1)
    at = first[:-1] + np.arange(texts)
    seq = np.empty(len(hashes) + texts, dtype=np.int64)
    closing = first[1:] + np.arange(texts)
    word = np.ones(len(seq), dtype=bool)
    word[closing] = False
    seq[word] = number + 1 + texts
    seq[closing] = np.arange(texts) + 1
    return seq, at, doc, vocabulary


def first_keys(seq: np.ndarray) -> tuple[np.ndarray, int]:
    """The first few words of each suffix in one integer, and how many they are."""
    top = int(seq.max()) + 1 if len(seq) else 1
    take = 3 if top <= 1 << 21 else 2
    bits = 62 // take
    padded = np.concatenate([seq, np.zeros(take, dtype=np.int64)])
    key = np.zeros(len(seq), dtype=np.int64)
    for j in range(take):
        key = (key << bits) | padded[j : j + len(seq)]
    return key, take


def suffix_array(seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` words at least, and the keys of their first words in that order.

    Prefix doubling that sorts again only what is still tied.
    """
    n = len(seq)
    key, h = first_keys(seq)
    sa = np.argsort(key, kind="quicksort")
    ordered = key[sa]
    new = np.ones(n, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while h < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        pos = sa[slots]
        pair = (rank[pos] << 32) | (rank[np.minimum(pos + h, n)] + 1)
        order = np.argsort(pair, kind="quicksort")
        sa[slots] = pos[order]
        pair = pair[order]
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[slots] = fresh
        rank[sa[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        h *= 2
    return sa, ordered


class Prefixes:
    """Longest common prefixes of suffixes, by comparing hashes of their beginnings."""

    def __init__(self, seq: np.ndarray) -> None:
        self.n = len(seq)
        self.total = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(mix(seq.astype(np.uint64)) * powers(_Q, self.n), out=self.total[1:])
        self.inverse = powers(_QI, self.n + 1)

    def hash(self, i: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.total[i + size] - self.total[i]) * self.inverse[i]

    def common(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        size = np.zeros(len(i), dtype=np.int64)
        room = np.minimum(self.n - np.maximum(i, j), most)
        step = 1 << max(0, int(most).bit_length() - 1)
        while step:
            ok = np.flatnonzero(size + step <= room)
            a, b, s = i[ok], j[ok], size[ok]
            same = self.hash(a + s, step) == self.hash(b + s, step)
            size[ok[same]] += step
            step >>= 1
        return size


def smaller_neighbours(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before and after it, in its group, with a smaller value; -1 where there is none."""

    def before(v: np.ndarray, g: np.ndarray) -> np.ndarray:
        start = np.concatenate([[True], g[1:] != g[:-1]])
        link = np.where(start, -1, np.arange(len(v)) - 1)
        act = np.flatnonzero(link >= 0)
        act = act[v[link[act]] >= v[act]]
        while len(act):
            link[act] = link[link[act]]
            act = act[link[act] >= 0]
            act = act[v[link[act]] >= v[act]]
        return link

    if not len(value):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    after = before(value[::-1], group[::-1])[::-1]
    return before(value, group), np.where(after >= 0, len(value) - 1 - after, -1)
