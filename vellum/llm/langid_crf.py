"""Language identification by a linear-chain conditional random field over words.

Each word gets a label: one of the languages that the training rows name, or ``und`` for tokens of no language (numbers,
codes, random letters).  Emission weights belong to hashed features of the word: its beginning and end (affixes), its
byte pairs and triples (n-grams) and the word itself (lexicon).  Transition weights between the labels of neighbouring words are
learned with them, by gradient steps on the likelihood of code-switched sequences made of spans of the labelled rows.
Words are labelled by their marginals from the forward-backward algorithm, over the whole text.

The chain of a batch is worked off in blocks: the product of each block's transfer matrices, then the vectors between
blocks, then those inside all blocks at once.  That is exact, and a text of a million words costs no more a word than a short one.

A document's language is the most frequent label but ``und``.  It is rejected where it has no word of a language, or the share of
all languages together in its words is below ``min_share``: neither numbers and addresses beside a sentence nor many languages condemn it.

Training reads at most ``TRAIN_DOCS`` labelled rows of each language, of however many languages; scoring reads everything.  With many
languages the sequences to train on grow with them, gradients are summed over pieces, and texts are worked on in smaller slices.

Defined results: null, empty and wordless texts, and those of no language, have none (lang_pred null, share and confidence 0) and are rejected; rows with a
null or blank language or a null id train nothing, nor do tables without the column; ties between labels go to the first in alphabetical order; repeated rows get equal results; without any
labelled row every word is ``und``; an empty table gives an empty one; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.bytewords import Words, mix, slices, words

UND, BUCKETS, TRAIN_DOCS, SEQUENCES, STEPS, MIN_SHARE = "und", 1 << 16, 150, 1500, 60, 0.25
#: Sequences for each language at least; the most labels for which blocks are worked off; scores (words x labels) held at once in training.
OF_EACH, BLOCK_LABELS, PIECE = 24, 16, 1 << 22


@dataclass
class Model:
    labels: list[str]
    emit: np.ndarray
    trans: np.ndarray
    start: np.ndarray


def type_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, word) of each word's features."""
    n = len(start)
    size = end - start
    padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)]).astype(np.uint64)
    every = np.arange(n)
    feat, val, owner = [hashes, np.full(n, 1 << 50, dtype=np.uint64) + np.minimum(size, 20).astype(np.uint64)], [np.ones(n), np.ones(n)], [every, every]
    for k in (1, 2, 3):
        for kind, at in ((k, start), (4 + k, end - k)):
            ok = np.flatnonzero(size >= k)
            code = np.full(len(ok), kind << 40, dtype=np.uint64)
            for j in range(k):
                code += padded[at[ok] + j] << np.uint64(8 * j)
            feat.append(code)
            val.append(np.ones(len(ok)))
            owner.append(ok)
    for k in (2, 3):
        count = np.maximum(size - k + 1, 0)
        who = np.repeat(every, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[who]
        code = np.full(len(at), (8 + k) << 40, dtype=np.uint64)
        for j in range(k):
            code += padded[at + j] << np.uint64(8 * j)
        feat.append(code)
        val.append(1.5 / np.maximum(count, 1)[who])
        owner.append(who)
    value, owner_ = np.concatenate(val).astype(np.float32), np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    index = (mix(np.concatenate(feat)) >> np.uint64(20)) % np.uint64(BUCKETS)
    return index[order].astype(np.int64), value[order], owner_[order]


def emissions(model: Model, w: Words) -> np.ndarray:
    """(words, labels) scores; features are made once for each distinct word of the batch."""
    hashes = w.hashes()
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    feat, val, owner = type_features(w.data, w.start[at], w.end[at], hashes[at])
    first = np.searchsorted(owner, np.arange(len(at)))
    return np.add.reduceat(model.emit[feat] * val[:, None], first, axis=0)[inverse]


def _unit(x: np.ndarray, axes: int | tuple) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def messages(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors of each word, each scaled to sum 1, and exp of the scaled scores; ``first`` as in Words."""
    n, k = score.shape
    e = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
    a, s = np.exp(trans), np.exp(start)
    if k > BLOCK_LABELS:
        return *_by_place(e, first, a, s), e
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    ep = np.ones((blocks * size, k))
    ep[:n] = e
    begins = np.ones(blocks * size, dtype=bool)
    begins[:n] = False
    begins[first[:-1][first[:-1] < first[1:]]] = True
    ep, begins = ep.reshape(blocks, size, k), begins.reshape(blocks, size)
    product = np.tile(np.eye(k), (blocks, 1, 1))
    for j in range(size):
        b = begins[:, j, None, None]
        product = np.where(b, product.sum(axis=2, keepdims=True) * s, product @ a) * ep[:, j, None, :]
        product = _unit(product, (1, 2))
    into = np.empty((blocks, k))
    out = np.empty((blocks, k))
    v = np.full(k, 1 / k)
    for i in range(blocks):
        into[i] = v
        v = _unit(v @ product[i], 0)
    v = np.full(k, 1 / k)
    for i in range(blocks - 1, -1, -1):
        out[i] = v
        v = _unit(product[i] @ v, 0)
    forward, backward = np.empty_like(ep), np.empty_like(ep)
    for j in range(size):
        into = _unit(np.where(begins[:, j, None], s, into @ a) * ep[:, j], 1)[:, :]
        forward[:, j] = into
    for j in range(size - 1, -1, -1):
        backward[:, j] = out
        got = ep[:, j] * out
        out = _unit(np.where(begins[:, j, None], (got @ s)[:, None] * np.ones(k), got @ a.T), 1)
    return forward.reshape(-1, k)[:n], backward.reshape(-1, k)[:n], e


def _by_place(e: np.ndarray, first: np.ndarray, a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same vectors, all texts at once, place by place: a word costs the square of the labels, not the cube as in blocks."""
    long = np.argsort(-np.diff(first), kind="stable")
    at, size = first[:-1][long], np.diff(first)[long]
    forward, backward = np.empty_like(e), np.full_like(e, 1 / e.shape[1])
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # texts with more words than the place
    for j, m in enumerate(active.tolist()):
        now = at[:m] + j
        forward[now] = _unit((forward[now - 1] @ a if j else s) * e[now], 1)
    for j in range(len(active) - 2, -1, -1):
        now = at[: active[j + 1]] + j
        backward[now] = _unit((e[now + 1] * backward[now + 1]) @ a.T, 1)
    return forward, backward


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    if not len(score):
        return score
    forward, backward, _ = messages(score, first, trans, start)
    return _unit(forward * backward, 1)


def training_sequences(rows: list[tuple[str, str]], seed: int = 7, sequences: int = SEQUENCES) -> tuple[list[str], np.ndarray, list[str]]:
    """Code-switched texts, the label of each of their words, and the labels.  Spans come from anywhere in the rows' texts."""
    langs = sorted({lang for lang, _ in rows})
    labels = [*langs, *([] if UND in langs else [UND])]
    rng = np.random.default_rng(seed)
    by: dict[str, list[list[str]]] = {lang: [] for lang in langs}
    for lang, text in rows:
        w = words(pa.array([text]))
        data = w.data.tobytes()
        if len(w):
            by[lang].append([data[a:z].decode("utf-8", "ignore") for a, z in zip(w.start.tolist(), w.end.tolist())])
    langs = [lang for lang in langs if by[lang]]
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))

    def noise() -> str:
        kind = rng.integers(3)
        n = int(rng.integers(3, 14))
        if kind == 0:
            return "".join(map(str, rng.integers(0, 10, n)))
        return "".join(rng.choice(letters, n)) if kind == 1 else "".join(rng.choice(list("0123456789abcdef"), n))

    texts, gold = [], []
    for _ in range(sequences if langs else 0):
        out: list[str] = []
        for _ in range(int(rng.integers(1, 4))):
            if rng.random() < 0.08:
                n = int(rng.integers(1, 8))
                out += [noise() for _ in range(n)]
                gold += [UND] * n
                continue
            lang = langs[rng.integers(len(langs))]
            doc = by[lang][rng.integers(len(by[lang]))]
            a, n = int(rng.integers(len(doc))), int(rng.integers(4, 40))
            part = doc[a : a + n]
            out += part
            gold += [UND if any(c.isdigit() for c in x) else lang for x in part]
        texts.append(" ".join(out))
    number = {x: i for i, x in enumerate(labels)}
    return texts, np.array([number[g] for g in gold], dtype=np.int64), labels


def train(rows: list[tuple[str, str]], seed: int = 7, steps: int = STEPS, sequences: int = SEQUENCES) -> Model:
    """Adam on the whole likelihood of the training sequences."""
    texts, gold, labels = training_sequences(rows, seed, max(sequences, OF_EACH * len({lang for lang, _ in rows})))
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not len(gold):
        model.emit[:, labels.index(UND)] = 1
        return model
    w = words(pa.array(texts))
    hashes = w.hashes()
    _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    feat, val, owner = type_features(w.data, w.start[at], w.end[at], hashes[at])
    used, compact = np.unique(feat, return_inverse=True)
    first = np.searchsorted(owner, np.arange(len(at)))
    begins = np.zeros(len(w), dtype=bool)
    begins[w.first[:-1][np.diff(w.first) > 0]] = True
    inner = np.flatnonzero(~begins)
    cuts = [0]
    for d, z in enumerate(w.first[1:].tolist(), 1):
        if (z - w.first[cuts[-1]]) * k > PIECE or d == len(w.first) - 1:
            cuts.append(d)
    emit = np.zeros((len(used), k))
    params = [emit, model.trans, model.start]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pair = np.zeros((k, k))
    np.add.at(pair, (gold[inner - 1], gold[inner]), 1)
    for step in range(1, steps + 1):
        types = np.stack([np.add.reduceat(emit[compact, j] * val, first) for j in range(k)], axis=1)
        per_type, xi, starts, back = np.zeros((len(at), k)), np.zeros((k, k)), np.zeros(k), np.exp(model.trans)
        for x, z in zip(cuts, cuts[1:]):
            lo, hi = w.first[x], w.first[z]
            forward, backward, e = messages(types[inverse[lo:hi]], w.first[x : z + 1] - lo, model.trans, model.start)
            diff = -_unit(forward * backward, 1)
            diff[np.arange(hi - lo), gold[lo:hi]] += 1
            own = np.flatnonzero(~begins[lo:hi])
            after = (e * backward)[own]
            before = forward[own - 1]
            xi += back * (before.T @ (after / ((before @ back) * after).sum(axis=1, keepdims=True)))
            per_type += np.stack([np.bincount(inverse[lo:hi], diff[:, j], len(at)) for j in range(k)], axis=1)
            starts += diff[begins[lo:hi]].sum(axis=0)
        grad = [np.stack([np.bincount(compact, per_type[owner, j] * val, len(used)) for j in range(k)], axis=1), pair - xi, starts]
        for p, g, a, b in zip(params, grad, m1, m2):
            g = g / len(w) - 1e-6 * p
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p += 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    model.emit[used] = emit
    return model


def training_rows(docs: DataFrame, per_language: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """(language, text) of at most ``per_language`` different rows of each language, in order of a hash of their ids; none without a column ``lang``."""
    if "lang" not in docs.columns:
        return []
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    known = docs.select(lang.alias("lang"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64("text").alias("t")).where("lang is not null and doc_id is not null and text is not null and trim(lang) <> ''")
    w = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    ids = known.select("lang", "doc_id", "t", F.xxhash64("doc_id").alias("h")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_language)
    # At most per_language rows of each language, so they may be sent to all tasks; rows repeated whole are gathered once.
    rows = known.join(F.broadcast(ids.select("lang", "doc_id", "t").distinct()), ["lang", "doc_id", "t"], "left_semi").groupBy("lang", "doc_id", "t").agg(F.min("text").alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"]))]


def label_batch(model: Model, texts: pa.Array, min_share: float) -> tuple[np.ndarray, ...]:
    """Per text: label number (-1: none), share, confidence, words, switches, keep; and the label of each word with its first-word offsets."""
    w = words(texts)
    n, k = len(w.first) - 1, len(model.labels)
    count = np.diff(w.first)
    if not len(w):
        zero = np.zeros(n)
        return np.full(n, -1), zero, zero, count, count, zero > 0, np.zeros(0, np.int64), w.first
    marg = marginals(emissions(model, w), w.first, model.trans, model.start)
    label = marg.argmax(axis=1)
    doc = w.doc()
    votes = np.bincount(doc * k + label, minlength=n * k).reshape(n, k)
    und = model.labels.index(UND)
    tongue = votes.copy()
    tongue[:, und] = -1
    best = tongue.argmax(axis=1)
    best = np.where(votes[np.arange(n), best] > 0, best, und)
    best_und = best == und
    some = np.maximum(count, 1)
    share = votes[np.arange(n), best] / some
    confidence = np.bincount(doc, marg[np.arange(len(w)), best[doc]], n) / some
    turn = np.zeros(len(w), dtype=np.int64)
    turn[1:] = (label[1:] != label[:-1]) & (doc[1:] == doc[:-1])
    switches = np.bincount(doc, turn, n).astype(np.int64)
    keep = ~best_und & (1 - votes[:, und] / some >= min_share)
    return np.where(best_und, -1, best), np.where(best_und, 0, share), np.where(best_und, 0, confidence), count, switches, keep, label, w.first


SPANS = "array<struct<start:int,n:int,lang:string>>"


def identify(docs: DataFrame, model: Model | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, lang_pred, share, confidence, n_words, n_switches, spans, keep) of every row; spans are runs of words with one label."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(training_rows(docs)))
    kind = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(sent.value.labels)
        for whole in batches:
            for b in slices(whole, limit=(1 << 20) * BLOCK_LABELS // max(BLOCK_LABELS, len(sent.value.labels))):
                best, share, confidence, count, switches, keep, label, first = label_batch(sent.value, b.column("text"), min_share)
                new = np.ones(len(label), dtype=bool)
                new[1:] = label[1:] != label[:-1]
                new[first[:-1][first[:-1] < first[1:]]] = True
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(label)))
                doc = np.searchsorted(first, at, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(at - first[doc], pa.int32()), pa.array(n, pa.int32()), labels.take(pa.array(label[at]))], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()), spans)
                lang = labels.take(pa.array(np.maximum(best, 0), mask=best < 0))
                cols = [b.column("doc_id"), lang, pa.array(np.round(share, 6)), pa.array(np.round(confidence, 6)), pa.array(count), pa.array(switches), lists, pa.array(keep)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "share", "confidence", "n_words", "n_switches", "spans", "keep"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id bigint, lang_pred string, share double, confidence double, n_words bigint, n_switches bigint, spans {SPANS}, keep boolean")


def keep_identified(docs: DataFrame, model: Model | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """The same columns, without rejected rows.  Needs no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(training_rows(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, limit=(1 << 20) * BLOCK_LABELS // max(BLOCK_LABELS, len(sent.value.labels))):
                yield b.filter(pa.array(label_batch(sent.value, b.column("text"), min_share)[5]))

    return docs.mapInArrow(run, docs.schema)
