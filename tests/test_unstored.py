"""The index whose postings are made when they are asked for, against the plain evaluator, and what its searches read."""

import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from test_search import CONFIG, as_hits, corpus, expected, query, ranked
from vellum.functions import scan
from vellum.functions.analysis import KEYWORD, STANDARD, STOP_WORDS, Analyzer, standard_tokens, standard_words
from vellum.operators.batch import search_many
from vellum.operators.index_build import lengths_of, postings, unstored, with_ids
from vellum.operators.search import search


@pytest.fixture(scope="module")
def index(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(s, o, *r) for s, o, *r in rows], "s int, o int, id string, title string, body string, tag string, note string")
    return rows, unstored(with_ids(df, F.col("s"), F.col("o")).drop("s", "o").coalesce(1).cache(), CONFIG)


@pytest.mark.parametrize("seed", range(100, 120))
def test_single_queries(index, seed):
    rows, snap = index
    text = query(random.Random(seed))
    assert ranked(as_hits(search(snap, text, CONFIG, top_k=None))) == ranked([h[:3] for h in expected(rows, text)]), text


def test_wanted_postings_are_those_of_all(index):
    rows, snap = index
    wanted = lambda field, term: ((field == "body") & term.startswith("qu")) | (term == "fox")
    whole = postings(*snap.source).where(wanted(F.col("field"), F.col("term")))
    part = postings(*snap.source, wanted)
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect())) != []


def test_batch(spark, index):
    rows, snap = index
    rng = random.Random(7)
    many = " ".join(f"w{i}" for i in range(150))
    texts = {f"q{i}": query(rng) for i in range(60)} | {"long": f"{many} fox", "musts": f"+fox +({many} quick)"}
    got = {}
    for r in search_many(snap, spark.createDataFrame(list(texts.items()), "query_id string, text string"), CONFIG, top_k=1000).collect():
        got.setdefault(r.query_id, []).append((r.doc_id, int(r.segment_id), round(r.score, 6)))
    for q, text in texts.items():
        assert ranked(got.get(q, [])) == ranked([h[:3] for h in expected(rows, text)]), text
    assert got["long"] and got["musts"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bool_must", "bool_should", "wildcard_suffix", "must_not_phrase", "multi_segment_topk", "merge_postings", "merge_stats"])
def test_registered_queries_keep_no_postings(spark, sf_dir, name):
    text = plan(__spark_entry__.queries()[name](spark, sf_dir))
    kept = [x for x in text.split("\n") if "InMemoryTableScan" in x]
    assert not [x for x in kept if "positions" in x or "term" in x]


def test_a_phrase_search_keeps_the_statistics_alone(spark, sf_dir):
    text = plan(__spark_entry__.queries()["phrase_should_partial_score"](spark, sf_dir))
    kept = [x for x in text.split("\n") if "InMemoryTableScan" in x]
    # All postings with their places would be several times the documents.
    assert kept and not [x for x in kept if "positions" in x or "term" in x]


def test_runs_are_cut_as_the_words_of_queries(spark):
    texts = ["İstanbul KELVIN_1 xKy", "Äpfel ẞ Straße9 ΣΣ", "a\U0001f600B2 The THE", "", "--", "_ __ 1 22"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", standard_tokens(F.col("t")).alias("k"))
    assert {r.t: [(k.term, k.position) for k in r.k] for r in df.collect()} == {t: standard_words(t) for t in texts}
    assert "split(lower" not in plan(df) and "lower(t" not in plan(df)


def test_a_batch_copies_postings_where_their_document_stands(spark, sf_dir):
    text = plan(__spark_entry__.queries()["batch_topk"](spark, sf_dir))
    # Nothing is shuffled by query and document.
    assert not [x for x in text.split("\n") if "Exchange hashpartitioning(query_id#" in x and "doc_ord#" in x.split("ENSURE")[0]]


def generated(spark, make):
    """The rows that each explode of the plan gave, after the plan ran."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = make()
        df.collect()
        nodes, out = [df._jdf.queryExecution().executedPlan()], []
        while nodes:
            p = nodes.pop()
            if p.nodeName() == "Generate":
                out.append(p.metrics().apply("numOutputRows").value())
            nodes += [p.children().apply(i) for i in range(p.children().size())]
        return out
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


#: By finding: each shares the step in which tokens are sought.
SOUGHT = [
    "bool_and_or_not",
    "phrase_should_partial_score",
    "bool_should",
    "bool_must_not",
    "bool_must_should",
    "bool_nested_group",
    "bool_nested_not_ignored",
    "boost_zero",
    "field_boost",
    "group_boost",
    "must_not_phrase",
]


@pytest.mark.parametrize("name", SOUGHT)
def test_fields_without_a_wanted_term_leave_no_row(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = generated(spark, lambda: __spark_entry__.queries()[name](spark, sf_dir))
    # Words stand in two of the six indexed fields.
    assert rows and max(rows) < 2 * docs


def test_lengths_are_counted_without_tokens(index):
    _, snap = index
    assert "position" not in plan(lengths_of(*snap.source))


def test_counted_and_sought_tokens_are_those_of_all(spark):
    texts = ["", None, "  ", "fox", "-the fox THE Fox x xx", "İx Kelvin fox", "because becauses although a_b 12 1", "ä fox ß Fox"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for a in (STANDARD, KEYWORD, Analyzer("other", STANDARD.column, STANDARD.words)):
        wanted = lambda term: term.isin("fox", "the", "kelvin", "because", "becauses")
        got = df.select("i", a.column(F.col("t")).alias("all"), a.count(F.col("t")).alias("n"), a.sought(F.col("t"), wanted).alias("s")).collect()
        for r in got:
            every = [(t.term, t.position) for t in r.all or []]
            some = [t for t in every if t[0] in ("fox", "the", "kelvin", "because", "becauses")]
            assert every == a.words(texts[r.i] or "") and max(r.n or 0, 0) == len(every)
            assert [([(t.term, t.position) for t in s.tokens], s.length) for s in r.s or []] == ([(some, len(every))] if some else [])


@pytest.mark.parametrize("name", ["bool_should", "phrase_should_partial_score"])
def test_words_are_scanned_not_cut(spark, sf_dir, name):
    text = plan(__spark_entry__.queries()[name](spark, sf_dir))
    scans = [x for x in text.split("\n") if "ArrowEvalPython" in x]
    # The three fields of the standard analyzer meet in each scan, and no text is cut into an array of words.
    assert len(scans) >= 2 and all(x.count("run(") == 3 for x in scans) and "split(" not in text


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_scanned_tokens_are_those_of_the_analyzer(monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rng, stops = random.Random(block), scan.Heads(scan.head(w.encode()) for w in STOP_WORDS)
    parts = ["a", "B", "the", "The", "although", "althoughX", "fox", "K", "İ", "_", "9", "ä", "ß", " ", "-", "\n", "erin", "wordslon", "wordslonger", "\0", "日本"]
    terms = ["fox", "the", "erin", "althoughx", "althoughxx", "wordslon", "wordslonger", "k9", "foxk", "src 1", "ä"]
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(rng.randrange(12))]
        for kind in (pa.string(), pa.large_string()):
            given = pa.array(["fox", *texts, "fox"], kind).slice(1, len(texts))
            every = [standard_words(t or "") for t in texts]
            assert scan.counted(given, stops).to_pylist() == [len(w) for w in every]
            found = [[{"tokens": [{"term": t, "position": i} for t, i in w if t in terms], "length": len(w)}] if any(t in terms for t, _ in w) else [] for w in every]
            assert pickle.loads(pickle.dumps(scan.Finder(terms, STOP_WORDS))).find(given).to_pylist() == found
            assert scan.Finder(["src 1"], STOP_WORDS).find(given).to_pylist() == [[]] * len(texts)


def test_found_tokens_are_those_sought(spark):
    texts = ["", None, "fox", "-the fox THE Fox x xx", "İx Kelvin fox", "a_b 12 1", "ä fox ß Fox"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    terms = ("fox", "the", "kelvin", "12")
    wanted = lambda term: term.isin(*terms)
    got = df.select(STANDARD.sought(F.col("t"), wanted).alias("a"), STANDARD.sought(F.col("t"), wanted, terms).alias("b")).collect()
    assert [r.a or [] for r in got] == [r.b for r in got] and any(r.b for r in got)
