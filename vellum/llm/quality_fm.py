"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is  w0 + sum_j w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j.  The pair sum is evaluated in linear
time by  1/2 sum_f [(sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2].  Word features are damped counts scaled to length 1 in each
document; structure statistics (length, word length, shares of capitals, digits, marks and blanks, share of distinct words, line length) and
metadata (source, language) are one-hot with value ``SIDE``.

Training (logistic loss, AdaGrad) reads at most ``TRAIN_DOCS`` labelled rows of each class, in order of a hash of their ids; scoring
reads every document whole.

Defined results: null and empty texts are scored by their statistics and metadata; null source or language is a category of its own;
missing columns likewise; labels that are null or whose document is missing train nothing, contradicting labels of one id train as they are, and an id that occurs
more than once trains by the least of its texts;
with no labels, or of one class only, every score is that class's prior (0.5 without labels); repeated rows get equal scores; an empty table
gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bytewords import mix, slices, span_hashes, words, buffers

BUCKETS, FACTORS, TRAIN_DOCS, EPOCHS, SIDE, THRESHOLD = 1 << 17, 8, 2000, 12, 0.35, 0.5


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def _level(value: np.ndarray, kind: int) -> np.ndarray:
    return (mix(np.clip(value, 0, 255).astype(np.uint64) + np.uint64((kind + 1) << 32)) % np.uint64(BUCKETS)).astype(np.int64)


def featurise(texts: pa.Array, meta: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR (first, index, value): one entry for each distinct feature of each text."""
    raw, at = buffers(texts)
    w = words(texts)
    n = len(at) - 1
    size = np.diff(at)
    count = np.diff(w.first)
    bucket = (w.hashes() % np.uint64(BUCKETS)).astype(np.int64)
    key = np.sort(w.doc() * BUCKETS + bucket)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    slot = np.flatnonzero(new)
    times = np.diff(np.append(slot, len(key)))
    doc, index = key[slot] // BUCKETS, key[slot] % BUCKETS
    value = 1 + np.log(times)
    length = np.sqrt(np.bincount(doc, value * value, n))
    value = value / np.maximum(length, 1e-9)[doc]

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(size, 1)

    chars = np.zeros(n)
    if len(w):
        chars = np.bincount(w.doc(), w.end - w.start, n)
    distinct = np.bincount(doc, minlength=n) / np.maximum(count, 1)
    lines = share(raw == 10) * size + 1
    stats = [
        np.log2(size + 1) * 2, np.log2(count + 1) * 2, chars / np.maximum(count, 1) * 4, share((raw >= 65) & (raw < 91)) * 40, share((raw >= 48) & (raw < 58)) * 40,
        share((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 90) & (raw < 97) | (raw > 122) & (raw < 128)) * 40, share((raw == 32) | (raw == 10) | (raw == 9)) * 40, distinct * 20, np.log2(count / lines + 1) * 2, share(raw >= 128) * 20,
    ]
    side = [_level(x, k) for k, x in enumerate(stats)]
    for k, column in enumerate(meta):
        data, offsets = buffers(column)
        named = (span_hashes(data, offsets[:-1], offsets[1:]) + np.uint64(k + 77)) if len(data) else np.full(n, k + 77, dtype=np.uint64)
        named = np.where(column.is_null().to_numpy(zero_copy_only=False), np.uint64(k + 7), named)
        side.append((mix(named) % np.uint64(BUCKETS)).astype(np.int64))
    every = np.arange(n)
    doc = np.concatenate([doc, *[every] * len(side)])
    index = np.concatenate([index, *side])
    value = np.concatenate([value, np.full(n * len(side), SIDE)])
    order = np.argsort(doc, kind="stable")
    return np.searchsorted(doc[order], np.arange(n + 1)), index[order], value[order]


def raw_scores(model: Model, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    if len(first) < 2:
        return np.zeros(0)
    at = first[:-1]
    vx = model.factor[index] * value[:, None].astype(np.float32)
    total = np.add.reduceat(vx, at, axis=0)
    squares = np.add.reduceat(vx * vx, at, axis=0)
    return model.bias + np.add.reduceat(model.weight[index] * value, at) + 0.5 * (total * total - squares).sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: pa.Array, meta: list[pa.Array], label: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(BUCKETS), (rng.standard_normal((BUCKETS, FACTORS)) * 0.02).astype(np.float32))
    if not len(label) or label.min() == label.max():
        model.factor[:] = 0
        model.bias = 0.0 if not len(label) else float(np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3)))
        return model
    model.bias = float(np.log(label.mean() / (1 - label.mean())))
    first, index, value = featurise(texts, meta)
    size = np.diff(first)
    gw, gv = np.full(BUCKETS, 1e-8), np.full((BUCKETS, FACTORS), 1e-8, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            n = size[some]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1][some], n)
            i, x = index[inner], value[inner]
            start = np.cumsum(n) - n
            own = np.repeat(np.arange(len(some)), n)
            vx = model.factor[i] * x[:, None]
            total = np.add.reduceat(vx, start, axis=0)
            squares = np.add.reduceat(vx * vx, start, axis=0)
            score = model.bias + np.add.reduceat(model.weight[i] * x, start) + 0.5 * (total * total - squares).sum(axis=1)
            g = (sigmoid(score) - label[some])[own] * x
            uniq, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, g, len(uniq)) / len(some) + 1e-6 * model.weight[uniq]
            dv_all = g[:, None] * (total[own] - vx)
            dv = np.stack([np.bincount(back, dv_all[:, f], len(uniq)) for f in range(FACTORS)], axis=1) / len(some) + 1e-6 * model.factor[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += (dv * dv).astype(np.float32)
            model.weight[uniq] -= 0.15 * dw / np.sqrt(gw[uniq])
            model.factor[uniq] -= (0.03 * dv / np.sqrt(gv[uniq])).astype(np.float32)
            model.bias -= 0.02 * float((sigmoid(score) - label[some]).mean())
    return model


def _columns(docs: DataFrame) -> DataFrame:
    text = lambda c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text("text"), text("source"), text("lang"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = TRAIN_DOCS) -> Model:
    """Trains on a bounded sample of the labelled rows; the ids are chosen first, so that only their texts move."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).select("doc_id", (F.col(target) > 0).alias("y"), F.xxhash64("doc_id").alias("h")).distinct()
    picked = [r for y in (True, False) for r in marked.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class).collect()]
    found = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["y"])) for r in picked], "id bigint, y int")
    # At most 2 x per_class ids, so they may be sent to all tasks.
    cols = _columns(docs)
    met = cols.join(F.broadcast(found), cols["doc_id"] == found["id"])
    # An id trains by one row, however often it occurs.
    one = met.groupBy("doc_id", "y").agg(F.min(F.struct("text", "source", "lang")).alias("r")).select("doc_id", "r.*", "y")
    rows = one.toPandas().sort_values(["doc_id", "y"], kind="stable")
    as_text = lambda c: pa.array(rows[c].tolist(), pa.string(), from_pandas=True)
    return train(as_text("text"), [as_text("source"), as_text("lang")], rows["y"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, quality_score, keep) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                p = sigmoid(raw_scores(sent.value, *featurise(b.column("text"), [b.column("source"), b.column("lang")])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(p, 6)), pa.array(p >= threshold)], names=["doc_id", "quality_score", "keep"])

    return _columns(docs).mapInArrow(run, "doc_id bigint, quality_score double, keep boolean")
