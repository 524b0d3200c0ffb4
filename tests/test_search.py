"""The engine, one query at a time and in batches, against the plain evaluator on random queries."""

import random

import pytest
from pyspark.sql import functions as F

from naive import Segment
from vellum.config import IndexConfig
from vellum.operators.batch import search_many
from vellum.operators.index_build import snapshot, with_ids
from vellum.operators.search import search
from vellum.plans.parser import parse

WORDS = ["quick", "brown", "fox", "the", "a", "lazy", "foo.bar", "foo", "bar", "v1_0", "x", "quickly", "Fox"]
CONFIG = IndexConfig(analyzers={"tag": "keyword"}, boost={"title": 2.0}, no_index=("note",))


def corpus(seed, n=14, segments=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(k)))
        rows.append((i % segments, i, f"d{i}", text(5) or None, text(12), rng.choice(["red", "deep blue", "a", "quick", None]), "quick"))
    return rows


def leaf(rng):
    word = rng.choice(WORDS)
    field = rng.choice(["", "", "title:", "body:", "tag:", "none:"])
    boost = rng.choice(["", "", "", "^2", "^0", "^x"])
    kind = rng.random()
    if kind < 0.5:
        return field + word + boost
    if kind < 0.8:
        return field + '"' + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) + '"' + rng.choice(["", "~1", "~2", "~x"]) + boost
    return field + rng.choice(["qu*", "*ck", "f?x", "*o*", "??", "*", "B*n"]) + boost


def query(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 4)):
        sign = rng.choice(["", "", "", "+", "-", "NOT "])
        part = f"({query(rng, depth + 1)}){rng.choice(['', '^2'])}" if depth < 2 and rng.random() < 0.25 else leaf(rng)
        parts.append(sign + part)
        if rng.random() < 0.3:
            parts.append(rng.choice(["AND", "OR"]))
    return " ".join(parts)


def expected(rows, text, deleted=frozenset()):
    out = []
    for s in sorted({r[0] for r in rows}):
        seg = Segment([(r[1], r[2], {"id": r[2], "title": r[3], "body": r[4], "tag": r[5]}) for r in rows if r[0] == s], CONFIG)
        out += [(i, s, round(score, 6), o) for o, i, score in seg.search(parse(text), deleted)]
    return sorted(out, key=lambda h: (-h[2], h[1], h[3]))


@pytest.fixture(scope="module")
def index(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(s, o, *r) for s, o, *r in rows], "s int, o int, id string, title string, body string, tag string, note string")
    snap = snapshot(with_ids(df, F.col("s"), F.col("o")).drop("s", "o"), CONFIG)
    for name in ("docs", "postings", "term_stats", "field_stats", "meta"):
        setattr(snap, name, getattr(snap, name).coalesce(1).cache())
    return rows, snap


def as_hits(df):
    return [(r.doc_id, int(r.segment_id), round(r.score, 6)) for r in df.collect()]


def ranked(hits):
    return sorted(hits, key=lambda h: (-h[2], h[1], int(h[0][1:])))


@pytest.mark.parametrize("seed", range(40))
def test_single_queries(index, seed):
    rows, snap = index
    text = query(random.Random(seed))
    got = as_hits(search(snap, text, CONFIG, top_k=None))
    assert ranked(got) == ranked([h[:3] for h in expected(rows, text)]), text


def test_batch(spark, index):
    rows, snap = index
    rng = random.Random(99)
    texts = {f"q{i}": query(rng) for i in range(400)} | {"blank": "  ", "range": "title:[a TO b]", "negative": "-fox"}
    got = {}
    for r in search_many(snap, spark.createDataFrame(list(texts.items()), "query_id string, text string"), CONFIG, top_k=1000).collect():
        got.setdefault(r.query_id, []).append((r.doc_id, int(r.segment_id), round(r.score, 6)))
    with_hits = 0
    for q, text in texts.items():
        want = [] if q == "range" else ranked([h[:3] for h in expected(rows, text)])
        with_hits += bool(want)
        assert ranked(got.get(q, [])) == want, text
    assert with_hits > 80


def test_limits_filter_and_order(index):
    rows, snap = index
    every = as_hits(search(snap, "fox quick", CONFIG, top_k=None))
    assert every == [h[:3] for h in expected(rows, "fox quick")]
    assert as_hits(search(snap, "fox quick", CONFIG, top_k=3)) == every[:3]
    assert search(snap, "fox quick", CONFIG, top_k=0).count() == 0
    kept = as_hits(search(snap, "fox quick", CONFIG, top_k=2, filter=F.col("tag") == "red"))
    red = {r[2] for r in rows if r[5] == "red"}
    assert kept == [h for h in every if h[0] in red][:2]


def test_range_is_refused(index):
    for text in ("year:[1 TO 2]", "a -(b [1 TO 2])"):
        with pytest.raises(ValueError, match="Range queries"):
            search(index[1], text, CONFIG)
