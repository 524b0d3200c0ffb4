"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import gzip
import io
import hashlib
import itertools
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from vellum.llm import bytewords, decontam, fingerprint, hamming_dedup, html_bp, langid_crf, line_chunks, lpf_dedup, packing, quality_fm, suffixes, warc

WORD = re.compile("[a-zA-Z0-9\x80-\U0010ffff]+")


def corpus(seed, n=40, vocabulary=30, size=60):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(size))) for _ in range(n)]
    for _ in range(n // 3):
        a, b = rng.randrange(n), rng.randrange(n)
        part = texts[a].split()
        at = rng.randrange(len(part) + 1)
        texts[b] = (texts[b] + ", " + " ".join(part[at : at + 25])).strip()
    texts[n - 1] = texts[0]
    return texts


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    w = bytewords.words(pa.array(texts, pa.string()), lower=False)
    data = w.data.tobytes()
    got = [[data[a:z].decode() for a, z in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert got == [WORD.findall(t) for t in texts]
    assert len({*itertools.chain(*got)}) == len({*w.hashes().tolist()})


def test_hashes_in_blocks():
    w = bytewords.words(pa.array(["one two three " * 50, "x" * 40, "one é"]))
    whole = bytewords.span_hashes(w.data, w.start, w.end)
    assert all((bytewords.span_hashes(w.data, w.start, w.end, n) == whole).all() for n in (1, 7, 64))


@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=80, deadline=None)
def test_suffix_array(seq, depth):
    s = np.array([*(np.array(seq) + 1), 1], dtype=np.int64)
    sa, _ = suffixes.suffix_array(s, depth)
    assert sorted(sa.tolist()) == list(range(len(s)))
    cut = [tuple(s[i : i + depth]) for i in sa]
    assert cut == sorted(cut)
    p = suffixes.Prefixes(s)
    i, j = np.arange(len(s) - 1), np.arange(1, len(s))
    want = [next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b) for a, b in zip(i, j)]
    assert p.common(i, j, 1000).tolist() == want


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6)), max_size=50))
@settings(max_examples=80, deadline=None)
def test_smaller_neighbours(pairs):
    pairs.sort(key=lambda p: p[0])
    g, v = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    before, after = suffixes.smaller_neighbours(v, g)
    for i in range(len(v)):
        assert before[i] == max((j for j in range(i) if g[j] == g[i] and v[j] < v[i]), default=-1)
        assert after[i] == min((j for j in range(i + 1, len(v)) if g[j] == g[i] and v[j] < v[i]), default=-1)


def plain_line_dedup(texts, divisor, least):
    """The same passages, text by text."""
    seen, out, mask = set(), [], (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def of_bytes(s):
        return mix(sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(s.encode())) & mask)

    for text in texts:
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if re.search(r"[^ \t\n\v\f\r]", x)]
        value = [of_bytes(lines[k]) for k in full]
        chunks, now = [], []
        for n, k in enumerate(full):
            now.append(k)
            if n == len(full) - 1 or mix((value[n] * 0x9E3779B97F4A7C15 + (value[n - 1] if n else 0)) & mask) % divisor == 0:
                chunks.append(now)
                now = []
        size = lambda i, j: sum(map(len, chunks[i : j + 1]))
        runs = set()
        for i in range(len(chunks)):
            runs |= {(i, j) for j in [next((j for j in range(i, len(chunks)) if size(i, j) >= least), None)] if j is not None}
            runs |= {(j, i) for j in [next((j for j in range(i, -1, -1) if size(j, i) >= least), None)] if j is not None}
        gone = set()
        for i, j in sorted(runs):
            a, b = chunks[i][0], chunks[j][-1]
            body = "\n".join(lines[a : b + 1])
            gone |= set(range(a, b + 1)) if body in seen else set()
            seen.add(body)
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def texts_of_lines(seed, n=40):
    rng, texts = random.Random(seed), []
    for i in range(n):
        lines = [f"own {i} {k}" for k in range(rng.randrange(4))]
        for k in range(rng.randrange(3)):
            a = rng.randrange(40)
            lines += [f"shared {x}" for x in range(a, a + rng.randrange(1, 9))] + rng.choice([[], [""], ["", " "]]) + [f"between {i} {k}é"] * rng.randrange(2)
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("divisor", range(1, 9))
@pytest.mark.parametrize("least", range(1, 5))
def test_passages_of_line_chunks(divisor, least):
    texts = texts_of_lines(divisor * 10 + least)
    seen, gone = set(), {}
    text, value, x, y = line_chunks.passages(pa.array(texts, pa.string()), divisor, least)
    for t, h, a, b in sorted(zip(text.tolist(), value.tolist(), x.tolist(), y.tolist()), key=lambda r: (r[0], r[2], r[3])):
        gone.setdefault(t, set()).update(range(a, b + 1) if h in seen else ())
        seen.add(h)
    assert ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in enumerate(texts)] == plain_line_dedup(texts, divisor, least)


@pytest.mark.parametrize("divisor, least", [(1, 2), (3, 2), (2, 3)])
def test_line_dedup(spark, divisor, least):
    texts = texts_of_lines(divisor)
    df = spark.createDataFrame([(d, t, len(t)) for d, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").repartition(3)
    got = {r.doc_id: r.text for r in line_chunks.line_dedup(df, divisor, least).collect()}
    want = dict(enumerate(plain_line_dedup(texts, divisor, least)))
    assert got == want and want != dict(enumerate(texts))
    if divisor == 1:
        assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == {d: (t, len(t)) for d, t in want.items()}


def test_line_hashes_that_deceive(spark, monkeypatch):
    texts = ["a\nb", "c\nd", "x\na\nb", "c\nd\ny", "e\nf"]

    def one_hash(batches):
        for b in batches:
            text, value, x, y = line_chunks.passages(b.column("text"), 1, 2)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("hash").take(take), pa.array(value * 0), pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["id", "hash", "h", "a", "b"])

    monkeypatch.setattr(line_chunks, "_units", lambda divisor, min_lines: one_hash)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    assert dict(line_chunks.line_dedup(df).collect()) == dict(enumerate(["a\nb", "c\nd", "x", "y", "e\nf"]))


@pytest.mark.parametrize("seed, hot, listed", [(1, 10**6, 100), (2, 10**6, 100), (1, 1, 10**6), (2, 2, 10**6), (2, 1, 0)])
def test_repeated_passages(spark, monkeypatch, seed, hot, listed):
    monkeypatch.setattr(lpf_dedup._spans_in, "__defaults__", (listed,))
    texts, least = corpus(seed), 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in lpf_dedup.removed_repeats(df, least, 3, hot).collect()}
    seen, want = set(), {}
    for d, text in enumerate(texts):
        at = [(m.start(), m.end()) for m in WORD.finditer(text)]
        w = [text[a:z] for a, z in at]
        gone = set()
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            if key in seen:
                gone |= set(range(i, i + least))
            seen.add(key)
        if gone:
            edge = [a for a, _ in at] + [len(text)]
            want[d] = text[: edge[0]] + "".join(text[edge[i] : edge[i + 1]] for i in range(len(w)) if i not in gone)
    assert got == want and want


@pytest.mark.parametrize("seed", [3, 4])
def test_longest_matches(spark, seed):
    texts = corpus(seed)
    items = [" ".join(texts[k].split()[2:30]).upper() for k in (1, 5, 9)] + ["w1 w2 w3", "", "nothing of this occurs anywhere in it at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    least = 6
    got = {(r.doc_id, r.item_id): (r.match_words, r.doc_word, r.item_word) for r in decontam.benchmark_matches(df, bench, least, 3).collect()}
    want = {}
    for (d, text), (k, item) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = WORD.findall(text.lower()), WORD.findall(item.lower())
        need = least if len(b) >= least else len(b) if len(b) >= 3 else 10**9
        best = None
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= need and (best is None or (-n, i, j) < best):
                best = (-n, i, j)
        if best:
            want[d, k] = (-best[0], *best[1:])
    assert got == want and want
    kept = {r.doc_id for r in decontam.decontaminate(df, bench, least, 3).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=3), st.sampled_from([1, 3, 1000]))
@settings(max_examples=150, deadline=None)
def test_matches_of_few_words(texts, items, pairs):
    before, decontam.PAIRS = decontam.PAIRS, pairs
    ready = decontam.Items([*range(len(items))], [" ".join(x) for x in items], 4, 3)
    got = {(t, k): x for t, k, *x in zip(*(x.tolist() for x in decontam.shard_matches(pa.array([" ".join(x) for x in texts]), ready)))}
    decontam.PAIRS = before
    want = {}
    for (t, a), (k, b) in itertools.product(enumerate(texts), enumerate(items)):
        need = 4 if len(b) >= 4 else 3 if len(b) == 3 else 99
        runs = [(-next((n for n in range(99) if a[i + n : i + n + 1] != b[j + n : j + n + 1] or i + n >= len(a)), 0), i, j) for i in range(len(a)) for j in range(len(b))]
        best = min(runs, default=(0,))
        if -best[0] >= need:
            want[t, k] = [-best[0], *best[1:]]
    assert got == want


def test_one_word_a_million_times():
    items = decontam.Items([1], ["0 " * 5000], 13, 5)
    assert [x.tolist() for x in decontam.shard_matches(pa.array(["0 " * 1_000_000, "0 1"]), items)] == [[0], [0], [5000], [0], [0]]


def test_bytes_decide_over_hashes(monkeypatch):
    real = bytewords.Words.hashes
    monkeypatch.setattr(bytewords.Words, "hashes", lambda self: real(self) // np.uint64(1 << 63))  # two hashes for all words
    texts, items = ["a b c d e f g h", "p q r s t u v w", "x a b c d y"], ["a b c d e f g h"]
    found = decontam.shard_matches(pa.array(texts), decontam.Items([0], items, 4, 3))
    assert [x.tolist() for x in found] == [[0, 2], [0, 0], [8, 4], [0, 1], [0, 0]]


def test_shards_lose_no_batch(monkeypatch):
    rows = [pa.RecordBatch.from_pydict({"text": [""], "other": ["x" * (1 << 20)]}) for _ in range(20)]
    got = list(decontam._sharded(lambda b: iter([b]))(iter(rows)))
    assert sum(b.num_rows for b in got) == 20 and max(b.nbytes for b in got) <= decontam.SHARD_BYTES + (2 << 20)

    class Apart:  # as Arrow leaves several chunks of a column that passes 2 GB
        from_batches = staticmethod(lambda held: type("T", (), {"combine_chunks": lambda self: self, "to_batches": lambda self: held})())

    monkeypatch.setattr(decontam.pa, "Table", Apart)
    assert sum(b.num_rows for b in decontam._sharded(lambda b: iter([b]))(iter(rows))) == 20


@pytest.mark.parametrize("digest, few", [(fingerprint.wide_digest, 1000), (fingerprint.wide_digest, 0), (lambda b: bytes([len(b) % 2] * 16), 1000)])
def test_fingerprints_of_equal_forms(spark, digest, few):
    forms = ["Stra\u00dfe", "STRASSE", "strasse ", "\ufb01n  de", "fin\tde", "\uff21bc", "abc", "e\u0301t\u00e9", "\u00e9t\u00e9", "e\u0301te", "", " \n", "other", None, None]
    docs = [(i, t) for i, t in enumerate(forms)] + [(None, "abc"), (12, "other"), (40, "OTHER")]
    got = sorted((str(r.doc_id), r.keeper_doc_id, r.group_size, r.is_copy) for r in fingerprint.fingerprint_groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), digest, few).collect())
    groups = {}
    for i, t in docs:
        if t is not None:
            key = " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
            groups.setdefault(key, []).append(i)
    want = []
    for i, t in docs:
        g = groups[" ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())] if t is not None else [i]
        keeper = min((x for x in g if x is not None), default=None)
        want.append((str(i), keeper, len(g), i != keeper))
    assert got == sorted(want) and {len(g) for g in groups.values()} == {1, 2, 3}


def test_all_pairs_under_the_distance(spark):
    rng = np.random.default_rng(0)
    sig = rng.integers(0, 1 << 16, (120, hamming_dedup.PLACES)).astype(np.uint16)
    for i in range(40, 120):
        sig[i] = sig[rng.integers(0, 40)]
        where = rng.choice(hamming_dedup.PLACES, rng.integers(1, 40), replace=False)
        sig[i, where] = rng.integers(0, 1 << 16, len(where))
    rows = [((i, 0), sig[i].tobytes()) for i in range(120)]
    df = spark.createDataFrame(rows, "node struct<id:bigint,hash:bigint>, sig binary")
    got = {(r.a.id, r.b.id) for r in hamming_dedup.near_edges(df, all_pairs=True).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(120), 2) if (sig[a] != sig[b]).sum() <= hamming_dedup.LIMIT}
    assert got == want and len(want) > 30
    group = {i: i for i in range(120)}
    for _ in range(120):
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    for hot in (10**6, 2, 1):
        forest = hamming_dedup.near_edges(df, hot=hot)
        roots = {r.node.id: r.root.id for r in hamming_dedup.components(forest).collect()}
        assert roots == {i: g for i, g in group.items() if g != i}
        assert {(r.a.id, r.b.id) for r in forest.collect()} <= want


def test_second_keys():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, hamming_dedup.PLACES).astype(np.uint16)
        b = a.copy()
        where = rng.choice(hamming_dedup.PLACES, hamming_dedup.LIMIT, replace=False)
        b[where] += 1
        sig = np.stack([a, b])
        keys = hamming_dedup.chunk_keys(sig)
        shared = np.intersect1d(*keys)
        assert len(shared)
        for key in shared:
            assert len(np.intersect1d(*hamming_dedup.second_keys(sig, np.array([key, key]))))


def test_batches_by_key():
    rng = random.Random(2)
    for _ in range(100):
        key = sorted(rng.randrange(6) for _ in range(rng.randrange(30)))
        cuts = sorted(rng.randrange(len(key) + 1) for _ in range(rng.randrange(6)))
        batches = [pa.RecordBatch.from_pydict({"key": pa.array(key[a:z], pa.int64())}) for a, z in zip([0, *cuts], [*cuts, len(key)])]
        got = [t.column("key").to_pylist() for t in hamming_dedup._flush_by_key(iter(batches))]
        assert [k for t in got for k in t] == key and sum(len(set(t)) for t in got) == len(set(key))


def test_components_of_a_path(spark):
    order = list(range(64))
    random.Random(1).shuffle(order)
    edges = [((min(a, b), 0), (max(a, b), 0)) for a, b in zip(order, order[1:])]
    df = spark.createDataFrame(edges, "a struct<id:bigint,hash:bigint>, b struct<id:bigint,hash:bigint>")
    assert {(r.node.id, r.root.id) for r in hamming_dedup.components(df).collect()} == {(i, 0) for i in range(1, 64)}


def test_near_copies_are_found(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    docs, n = [], 60
    for i in range(n):
        text = [rng.choice(words) for _ in range(150)]
        docs.append((2 * i, " ".join(text)))
        for _ in range(6):
            text[rng.randrange(150)] = rng.choice(words)
        docs.append((2 * i + 1, " ".join(text)))
    gone = {(r.doc_id, r.keeper_doc_id) for r in hamming_dedup.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert gone <= {(2 * i + 1, 2 * i) for i in range(n)} and len(gone) >= 0.95 * n


def brute_marginals(score, trans, start):
    """Sums over all labellings."""
    n, k = score.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(start[path[0]] + sum(score[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            out[i, y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(1)
    sizes = [5, 0, 1, 6, 3, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score, trans, start = rng.standard_normal((first[-1], 3)) * 2, rng.standard_normal((3, 3)), rng.standard_normal(3)
    got = langid_crf.marginals(score, first, trans, start)
    for a, z in zip(first, first[1:]):
        if z > a:
            assert np.allclose(got[a:z], brute_marginals(score[a:z], trans, start))


def test_forward_backward_of_many_labels(monkeypatch):
    rng = np.random.default_rng(3)
    k, first = 5, np.array([0, 0, 7, 8, 8, 30, 33])
    score, trans, start = rng.normal(size=(33, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    want = langid_crf.marginals(score, first, trans, start)
    monkeypatch.setattr(langid_crf, "BLOCK_LABELS", 4)
    assert np.allclose(langid_crf.marginals(score, first, trans, start), want)


def test_more_than_64_languages(spark):
    rng = random.Random(4)
    letters = {f"l{i:02}": rng.sample("abcdefghijklmnopqrstuvwxyz", 6) for i in range(70)}
    text = lambda x: " ".join("".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(30))
    docs = [(i * 10 + k, text(x), x) for i, x in enumerate(letters) for k in range(3 if i < 69 else 2)]
    rows = langid_crf.training_rows(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert {x for x, _ in rows} == {*letters} and len(rows) == len(docs)
    model = langid_crf.train(rows, steps=30)
    best = langid_crf.label_batch(model, pa.array([t for _, t in rows]), 0.25)[0]
    assert np.mean([model.labels[b] == x for b, (x, _) in zip(best, rows)]) > 0.9
    assert model.labels[best[-1]] == "l69"


def test_languages_share_a_text():
    model = langid_crf.Model(["a", "b", "c", "d", "e", "und"], np.zeros((langid_crf.BUCKETS, 6), np.float32), np.zeros((6, 6)), np.zeros(6))
    data = ["alpha", "bravo", "crisp", "delta", "eagle", "12345"]
    w = bytewords.words(pa.array(data))
    feat = [langid_crf.type_features(w.data, w.start[i : i + 1], w.end[i : i + 1], w.hashes()[i : i + 1])[0][0] for i in range(6)]
    model.emit[feat, range(6)] = 30
    five, four, junk = " ".join(data[:5]), " ".join(data[:4] + data[5:] * 2), " ".join(data[:1] + data[5:] * 5)
    best, share, *_, keep, _, _ = langid_crf.label_batch(model, pa.array([five, four, junk]), 0.25)
    assert keep.tolist() == [True, True, False] and best.tolist() == [0, 0, 0] and np.allclose(share, [1 / 5, 1 / 6, 1 / 6])


def test_training_in_pieces(monkeypatch):
    rows = [("en", "the and of that with this from"), ("de", "der die das und nicht ist mit")]
    whole = langid_crf.train(rows, steps=10, sequences=60)
    monkeypatch.setattr(langid_crf, "PIECE", 200)
    pieces = langid_crf.train(rows, steps=10, sequences=60)
    assert np.allclose(whole.emit, pieces.emit, atol=1e-5) and np.allclose(whole.trans, pieces.trans)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")


def test_language_accuracy(documents):
    rows = [(r.lang, r.text) for r in documents.orderBy("doc_id").collect()]
    model = langid_crf.train(rows[:400])
    texts, gold, _ = langid_crf.training_sequences(rows[400:], seed=11, sequences=400)
    w = bytewords.words(pa.array(texts))
    score = langid_crf.emissions(model, w)
    assert (langid_crf.marginals(score, w.first, model.trans, model.start).argmax(axis=1) == gold).mean() > 0.95
    held = rows[400:]
    best, *_, keep, _, _ = langid_crf.label_batch(model, pa.array([t for _, t in held]), 0.25)
    assert np.mean([b >= 0 and model.labels[b] == lang for b, (lang, _) in zip(best, held)]) > 0.98
    assert keep.mean() > 0.99
    junk, *_, keep, _, _ = langid_crf.label_batch(model, pa.array(["123 456 789 0", "8f3a9 77b1c 90210 55"]), 0.25)
    assert not keep.any()


def test_quality_accuracy(spark, sf_dir, documents):
    at = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    model = quality_fm.fit(docs, train)
    got = quality_fm.score(docs.join(test, "doc_id", "left_semi"), model).join(test, "doc_id").toPandas()
    rank = got.quality_score.rank().to_numpy()
    y = got.quality.to_numpy() == 1
    auc = (rank[y].mean() - (y.sum() + 1) / 2) / (~y).sum()
    assert auc > 0.97 and got.keep[y].mean() > 0.97


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    model = quality_fm.Model(0.3, rng.standard_normal(quality_fm.BUCKETS), rng.standard_normal((quality_fm.BUCKETS, 4)).astype(np.float32))
    first, index, value = quality_fm.featurise(pa.array(["a b b c", "", "zeta!"]), [pa.array(["s", None, "t"]), pa.array(["en", "de", None])])
    got = quality_fm.raw_scores(model, first, index, value)
    for d, (a, z) in enumerate(zip(first, first[1:])):
        i, x = index[a:z], value[a:z]
        pairs = sum(model.factor[i[p]] @ model.factor[i[q]] * x[p] * x[q] for p, q in itertools.combinations(range(z - a), 2))
        assert np.isclose(got[d], model.bias + model.weight[i] @ x + pairs, rtol=1e-3, atol=1e-3)


@given(st.lists(st.integers(1, 12), max_size=7), st.integers(0, 25))
@settings(max_examples=120, deadline=None)
def test_best_filling(lengths, room):
    counts = {x: lengths.count(x) for x in lengths}
    got = packing.best_filling(counts, room)
    best = max((sum(c) for r in range(len(lengths) + 1) for c in itertools.combinations(lengths, r) if sum(c) <= room), default=0)
    assert sum(x * n for x, n in got.items()) == best and all(n <= counts[x] for x, n in got.items())


@pytest.mark.parametrize("rows", [10**6, 0])
def test_packing_round_trip(spark, rows):
    rng = random.Random(3)
    blank = lambda: rng.choice([" ", "\n", "  \t"])
    texts = [blank() * (i % 3 == 0) + "".join("w" * (1 + k % 3) + "é" * (k % 7 == 0) + blank() for k in range(int(rng.expovariate(1 / 40)))) for i in range(400)]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(7, texts[5]), (7, texts[7]), (8, None), (8, ""), (None, " \n")]
    out = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), 64, buckets=7, broadcast_rows=rows).collect()
    got, parts = [], {}
    for r in out:
        assert r.doc_ids == [p.doc_id for p in r.pieces]
        if r.window_id is None:
            assert len(r.pieces) == 1 and r.pieces[0].length == 0 and r.used is None and r.slack is None
        else:
            assert r.used == sum(p.length for p in r.pieces) <= 64 and r.slack == 64 - r.used and all(p.length == len(p.text.split()) > 0 for p in r.pieces)
        for p in r.pieces:
            parts.setdefault((p.doc_id, p.text_hash, p.piece), []).append(p)
    for (i, h, k), same in parts.items():
        if k == 0:
            text = "" if same[0].text is not None else None
            for n in range(len(parts)):
                if (i, h, n) not in parts:
                    break
                assert {p.text for p in parts[i, h, n]} == {parts[i, h, n][0].text} and len(parts[i, h, n]) == len(same) and parts[i, h, n][0].start == 64 * n
                text = None if text is None else text + parts[i, h, n][0].text
            got += [(i, text)] * len(same)
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    assert order(got) == order(docs)
    ids = [r.window_id for r in out if r.window_id is not None]
    assert len(ids) == len(set(ids)) <= sum(len(t.split()) for _, t in docs if t) // 64 + 2
    # The windows are those of a plain minimum-bin-slack run over the same pieces.
    left = sorted((p.length for r in out for p in r.pieces if p.length), reverse=True)
    plain = []
    while left:
        top = left.pop(0)
        fill = packing.best_filling({x: left.count(x) for x in left}, 64 - top)
        for x, n in fill.items():
            for _ in range(n):
                left.remove(x)
        plain.append(top + sum(x * n for x, n in fill.items()))
    assert sorted(plain) == sorted(r.used for r in out if r.window_id is not None)


def test_warc_round_trip(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").repartition(3)
    whole = warc.write_monolithic(pages, f"{tmp_path}/whole")
    index = warc.normalise(spark, whole, f"{tmp_path}/records").collect()
    want = {r.page_id: (r.url, r.html) for r in pages.collect()}
    assert len(index) == len(want) and {r.page_id for r in index} == set(want)
    for r in index:
        head, payload = warc.read_record(f"{tmp_path}/records/{r.file}", r.offset, r.length)
        assert (warc.fields(head)["warc-target-uri"], payload.decode()) == want[r.page_id]
    for path in whole:
        a, b = gzip.open(path).read(), gzip.open(path.replace("/whole/", "/records/")).read()
        assert a == b


def test_warc_of_odd_rows(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>", "f"), (1, "http://a", "<p>x</p>", "f"), (None, None, None, None), (2, "u\r\nv", "", None), (3, None, "é\r\n\r\nWARC/1.0", None), (4, "u", "y" * 3_000_000, "g")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, file string")
    base = f"{tmp_path}/a"
    index = warc.normalise(spark, warc.write_monolithic(pages.coalesce(1), f"{base}/whole"), f"{base}/records").collect()
    got = []
    for r in index:
        head, payload = warc.read_record(f"{base}/records/{r.file}", r.offset, r.length)
        got.append((r.page_id, warc.fields(head)["warc-target-uri"], payload.decode()))
    order = lambda x: sorted(x, key=str)
    assert order(got) == order([(i, (u or "").replace("\r", "").replace("\n", ""), h or "") for i, u, h, _ in rows])
    none = warc.normalise(spark, warc.write_monolithic(pages.limit(0), f"{base}/none"), f"{base}/empty")
    assert none.count() == 0 and none.columns == [x.split()[0] for x in warc.INDEX.split(", ")]


def test_warc_sources_of_equal_name(spark, tmp_path):
    paths = []
    for k in range(2):
        pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>")], "page_id bigint, url string, html string").coalesce(1)
        paths += warc.write_monolithic(pages, f"{tmp_path}/{k}")
    assert len({p.rsplit("/", 1)[-1] for p in paths}) == 1
    index = warc.normalise(spark, paths, f"{tmp_path}/out").collect()
    assert sorted(r.page_id for r in index if r.page_id is not None) == [0, 1]


def test_warc_shapes(tmp_path):
    one, two = warc.record("response", "1", "u", b"x" * 3_000_000), warc.record("request", "2", "", b"")
    shapes = {"members": gzip.compress(one) + gzip.compress(two), "stream": gzip.compress(one + two), "halves": gzip.compress((one + two)[:1000]) + gzip.compress((one + two)[1000:]), "empty": b"", "unclosed": gzip.compress(one + two[:-4])}
    for name, data in shapes.items():
        (tmp_path / name).write_bytes(data)
        rows = warc.normalise_file(str(tmp_path / name), str(tmp_path / f"{name}.out"))
        assert len(rows) == (0 if name == "empty" else 2)
        assert b"".join(gzip.decompress((tmp_path / f"{name}.out").read_bytes()[r[2] : r[2] + r[3]]) for r in rows) == (b"" if name == "empty" else one + two)
    (tmp_path / "cut").write_bytes(gzip.compress(one + two)[:-20])
    with pytest.raises((ValueError, zlib.error)):
        warc.normalise_file(str(tmp_path / "cut"), str(tmp_path / "cut.out"))
    assert b"".join(warc.inflate(io.BytesIO(shapes["stream"]))) == one + two


def test_sum_product():
    rng = np.random.default_rng(4)
    nodes = html_bp.Nodes()
    for page, source in enumerate(["<div><p>a <b>b</b></p><p>c</p></div>", "<ul><li>x"]):
        html_bp.parse(nodes, page, source)
    t = html_bp.tree(nodes)
    model = html_bp.Model(rng.standard_normal(html_bp.WEIGHTS), rng.standard_normal((html_bp.EDGES, 2, 2)))
    got, pair = html_bp.sum_product(t, model)
    n = len(t.parent)
    assert n < 15
    want, both = np.zeros((n, 2)), np.zeros((n, 2, 2))
    own = model.weight[t.feature].sum(axis=1)
    for states in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(own[i] * states[i] for i in range(n)) + sum(model.edge[t.edge[i], states[t.parent[i]], states[i]] for i in range(n) if t.parent[i] >= 0))
        for i in range(n):
            want[i, states[i]] += p
            if t.parent[i] >= 0:
                both[i, states[t.parent[i]], states[i]] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))
    inner = t.parent >= 0
    assert np.allclose(pair[inner], both[inner] / both[inner].sum(axis=(1, 2), keepdims=True))


def test_html_of_any_shape_takes_linear_time():
    for source, nodes in (("</p>" * 100_000, 1), ("<p><div>" + "<b>" * 5_000 + "</p>" * 100_000, 5_003), ("<div " * 100_000, 2), ("<!-- " * 100_000, 1), ("<b>" * 5_000 + "x", 5_002)):
        began, got = time.perf_counter(), html_bp.Nodes()
        html_bp.parse(got, 0, source)
        marginals, _ = html_bp.sum_product(html_bp.tree(got), html_bp.train([]))
        assert len(got.parent) == len(marginals) == nodes and time.perf_counter() - began < 20
    for source, texts in (("a<!-- x > b", ["a"]), ("a<script> x > b", ["a"]), ("a<!-- x --> b <!-- c", ["a", "b"]), ("a > b", ["a > b"]), ("a<!-->b", ["a"])):
        got = html_bp.Nodes()
        html_bp.parse(got, 0, source)
        assert [t for t in got.text if t] == texts


def test_html_accuracy(spark, sf_dir):
    at = sf_dir.replace("sf0.001", "sf0.01")
    known = html_bp.labelled_pages(spark.read.parquet(f"{at}/pages.parquet"), spark.read.parquet(f"{at}/documents.parquet"))
    assert len(known) > 200
    model, nodes = html_bp.train(known[:100]), html_bp.Nodes()
    for i, (source, _) in enumerate(known[100:]):
        html_bp.parse(nodes, i, source)
    gold = html_bp.gold_states(nodes, [d for _, d in known[100:]])
    leaf = np.array([x is not None for x in nodes.text])
    assert (((html_bp.sum_product(html_bp.tree(nodes), model)[0][:, 1] >= 0.5) == gold)[leaf]).mean() > 0.98


def test_pipeline(spark, sf_dir):
    """All five stages against plain versions, on all rows of the smallest tables."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    model = langid_crf.train(langid_crf.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    keep = []
    for i, text, _ in docs:
        w = bytewords.words(pa.array([text]))
        if len(w):
            forward, und = langid_crf.emissions(model, w), model.labels.index("und")
            best = plain_marginals(forward, model.trans, model.start).argmax(axis=1)
            if (best != und).any() and (best != und).mean() >= langid_crf.MIN_SHARE:
                keep.append((i, text))
    texts = dict(zip([i for i, _ in keep], plain_line_dedup([t for _, t in keep], 1, 2)))
    sig, has = hamming_dedup.minhash(bytewords.words(pa.array([texts[i] for i in texts], pa.string())))
    ids = [[*texts][k] for k in has]
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for x, y in itertools.combinations(range(len(ids)), 2):
        if (sig[x] != sig[y]).sum() <= hamming_dedup.LIMIT:
            a, b = sorted((root(ids[x]), root(ids[y])))
            group[b] = a
    left = [i for i in texts if i not in group or root(i) == i]
    assert 0 < len(left) < len(docs)
    grams = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {n: set().union(*(grams(t, n) for t in items if min(len(t), decontam.MIN_WORDS) == n)) for n in range(decontam.LEAST_ITEM, decontam.MIN_WORDS + 1)}
    left = [i for i in left if not any(b & grams(WORD.findall(texts[i].lower()), n) for n, b in bad.items() if b)]
    got, sizes, want = {}, [], []
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        sizes += [r.used] if r.window_id is not None else []
        for p in r.pieces:
            got.setdefault(p.doc_id, []).append((p.piece, p.text))
    assert {i: "".join(t for _, t in sorted(x)) for i, x in got.items()} == {i: texts[i] for i in left}
    pieces = sorted((n for i in left for k in [len(re.findall("[^ \\t\\n\\v\\f\\r]+", texts[i]))] for n in [packing.CAPACITY] * (k // packing.CAPACITY) + [k % packing.CAPACITY] if n), reverse=True)
    while pieces:
        top = pieces.pop(0)
        fill = packing.best_filling({x: pieces.count(x) for x in pieces}, packing.CAPACITY - top)
        for x, n in fill.items():
            for _ in range(n):
                pieces.remove(x)
        want.append(top + sum(x * n for x, n in fill.items()))
    assert sorted(sizes) == sorted(want)


def plain_marginals(score, trans, start):
    """Forward-backward of one text, word by word."""
    score = score.astype(float) - score.max(axis=1, keepdims=True)
    a, n = np.exp(trans), len(score)
    forward, backward = np.zeros_like(score), np.ones_like(score)
    for i in range(n):
        forward[i] = np.exp(score[i]) * (forward[i - 1] @ a if i else np.exp(start))
        forward[i] /= forward[i].sum()
    for i in range(n - 2, -1, -1):
        backward[i] = a @ (np.exp(score[i + 1]) * backward[i + 1])
        backward[i] /= backward[i].sum()
    return forward * backward
