"""Stores and files, rendering, analyzers, scorers, merge policy, readers, the experiment, and what reaches the files in searches."""

import json
import math

import pytest
from pyspark.sql import functions as F

from vellum.api import IndexSearcher, create_index
from vellum.config import IndexConfig, MergePolicy
from vellum.functions.analysis import KEYWORD, STANDARD, Analyzer, get_analyzer, register_analyzer
from vellum.functions.hashing import bucket_filename, bucket_for, bucket_for_key, num_buckets_for
from vellum.functions.render import render
from vellum.operators.batch import search_many
from vellum.operators.experiment import run_folder
from vellum.operators.scoring import BM25
from vellum.sources import files
from vellum.sources.corpora import from_parquet, malformed_lines, qrels_path, read_queries
from vellum.sources.store import MemoryStore, PathStore

CONFIG = IndexConfig(analyzers={"id": "keyword"}, no_store=("body",))


def docs(spark, n=12):
    return spark.createDataFrame([(f"d{i}", f"title number{i}", f"body word{i % 3} common") for i in range(n)], "id string, title string, body string").coalesce(1)


@pytest.mark.parametrize("scheme", ["", "file:", "file://", "viewfs://mounts"])
def test_files_of_every_scheme(spark, tmp_path, scheme):
    root = str(tmp_path)
    if scheme.startswith("viewfs"):
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.mounts.link./data", f"file://{tmp_path}")
        root = "/data"
    where = f"{scheme}{root}/x/y.json"
    assert not files.exists(where) and files.names(f"{scheme}{root}/x") == []
    files.delete(where)
    for value in ({"a": [1, "é\n"]}, {}):
        files.write_json(where, value)
        assert files.read_json(where) == value and files.names(f"{scheme}{root}/x") == ["y.json"]
    with pytest.raises(Exception, match="(?i)not.*(found|exist)"):
        files.read_json(f"{scheme}{root}/x/none.json")
    index = create_index(spark, f"{scheme}{root}/index", CONFIG, 5)
    index.writer.add_documents(docs(spark))
    index.writer.close()
    assert sorted(r.doc_id for r in index.searcher.search("word1").collect()) == ["d1", "d10", "d4", "d7"]
    files.delete(f"{scheme}{root}/x")
    assert not files.exists(where)


def test_memory_stores_are_apart(spark):
    one, two = MemoryStore(spark), MemoryStore(spark)
    assert one.path != two.path
    index = create_index(spark, None, CONFIG)
    index.writer.add_documents(docs(spark, 2))
    index.writer.close()
    assert {"docs", "postings", "term_stats", "field_stats"} <= set(index.searcher.store.dump()["seg-000001"])
    for store in (one, two, index.searcher.store):
        store.close()
        assert not files.exists(store.path)


def test_numbers_in_the_fewest_digits(spark):
    want = {
        1.0: "1", 0.5: "0.5", -2.25: "-2.25", 0.0005: "0.0005", 1.5e-6: "0.0000015", 12345678.5: "12345678.5", 0.1: "0.1", 1e16: "10000000000000000", 123456789012.125: "123456789012.125",
        1e20: "100000000000000000000", 1e21: "1e+21", 1.5e300: "1.5e+300", 1e-7: "1e-7", -1.25e-9: "-1.25e-9", 100.0: "100", -0.0: "0", 9007199254740991.0: "9007199254740991", 1234.5678: "1234.5678", math.inf: "Infinity", -math.inf: "-Infinity",
    }
    df = spark.createDataFrame([(float(v), t) for v, t in want.items()] + [(float("nan"), "NaN"), (None, None)], "v double, t string")
    bad = [(r.v, r.t, r.got) for r in df.select("v", "t", render(F.col("v"), df.schema["v"].dataType).alias("got")).collect() if r.t != r.got]
    assert bad == []


def test_other_types_as_text(spark):
    df = spark.sql("SELECT true AS b, 7 AS i, DATE'2024-02-03' AS d, TIMESTAMP_NTZ'2024-02-03 04:05:06.789' AS t, array(1, 2) AS a, named_struct('k', 'v') AS s, map('k', 1) AS m, CAST(NULL AS double) AS n")
    got = df.select(*[render(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert tuple(got) == ("true", "7", "2024-02-03T00:00:00.000Z", "2024-02-03T04:05:06.789Z", "[1,2]", '{"k":"v"}', '{"k":1}', None)


def test_analyzers_by_name(spark):
    assert get_analyzer("keyword") is KEYWORD and get_analyzer("standard") is STANDARD and get_analyzer("unknown") is STANDARD
    halves = Analyzer("halves", lambda c: F.transform(F.split(c, "/"), lambda t, i: F.struct(t.alias("term"), (i + 1).cast("int").alias("position"))), lambda t: [(x, i) for i, x in enumerate(t.split("/"), 1)])
    register_analyzer(halves)
    index = create_index(spark, None, IndexConfig(analyzers={"path": "halves"}))
    index.writer.add_documents(spark.createDataFrame([("1", "a/b"), ("2", "b/c")], "id string, path string"))
    index.writer.close()
    assert sorted(r.doc_id for r in index.searcher.search("path:b").collect()) == ["1", "2"] and [r.doc_id for r in index.searcher.search("path:a").collect()] == ["1"]


def test_scorers(spark):
    class Count:
        def contribution(self, tf, df, n_docs, length, avg_length):
            return tf.cast("double")

    index = create_index(spark, None, CONFIG)
    index.writer.add_documents(spark.createDataFrame([("1", "x1 x1 x1"), ("2", "x1 y1")], "id string, body string"))
    index.writer.close()
    own = IndexSearcher(index.searcher.store, CONFIG, Count())
    assert [(r.doc_id, r.score) for r in own.search("x1").collect()] == [("1", 3.0), ("2", 1.0)]
    flat = BM25().contribution(F.lit(2), F.lit(1), F.lit(3), F.lit(None).cast("int"), F.lit(None).cast("double"))
    got = spark.range(1).select(flat.alias("s")).first().s
    assert got == pytest.approx(math.log(2.5 / 1.5 + 1) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2)))


def test_merge_policy(spark, tmp_path):
    index = create_index(spark, str(tmp_path), CONFIG, 2, policy=MergePolicy(max_segments=6, merge_count=3))
    index.writer.add_documents(docs(spark))
    index.writer.commit()
    assert len(index.searcher.store.manifest()) == 6 and index.merger.maybe_merge() is None
    index.writer.delete_by_id("d0")
    index.writer.close()
    new = index.merger.maybe_merge()
    entries = index.searcher.store.manifest()
    assert new == entries[-1]["id"] and len(entries) == 5 and sum(e["doc_count"] for e in entries) == 12 - (entries[-1]["doc_count"] < 4)
    assert sorted(r.doc_id for r in index.searcher.search("common", top_k=None).collect()) == sorted(f"d{i}" for i in range(1, 12))


def test_a_batch_number_is_published_with_its_segments(spark, tmp_path):
    index = create_index(spark, str(tmp_path), CONFIG)
    store = index.searcher.store
    assert store.batch() == -1
    index.writer.add_documents(docs(spark, 2))
    index.writer.commit(4)
    assert json.loads((tmp_path / "segments.json").read_text())["batch"] == 4
    index.writer.add_documents(docs(spark, 1))
    index.writer.commit()
    index.merger.merge_all()
    assert PathStore(spark, str(tmp_path)).batch() == 4


def test_buckets(spark):
    keys = ["", "title:apple", "body:é\U0001f600", "x" * 100]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.b for r in df.select("k", bucket_for(F.col("k"), 64).alias("b")).collect()} == {k: bucket_for_key(k, 64) for k in keys}
    assert [num_buckets_for(n) for n in (0, 64_000, 64_001)] == [64, 64, 65] and bucket_filename(3) == "postings/bucket-3.json"


def test_more_readers(spark, tmp_path):
    for name in ("dev", "train"):
        (tmp_path / "qrels").mkdir(exist_ok=True)
        (tmp_path / "qrels" / f"{name}.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\n")
    assert qrels_path(str(tmp_path)).endswith("dev.tsv") and qrels_path(str(tmp_path), "train").endswith("train.tsv") and qrels_path(str(tmp_path), "test").endswith("dev.tsv") and qrels_path(str(tmp_path / "none")) is None
    spark.createDataFrame([("1", "t", "x")], "docid string, title string, contents string").write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([(1, 2, 1.0)], "`query-id` int, `corpus-id` int, score double").write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([("q", "text")], "_id string, query string").write.parquet(f"{tmp_path}/q")
    assert [tuple(from_parquet(spark, f"{tmp_path}/{p}", k).first()) for p, k in (("c", "corpus"), ("r", "qrels"), ("q", "queries"))] == [("1", "t", "x"), ("1", "2", 1), ("q", "text")]
    (tmp_path / "q.jsonl").write_text('﻿{"_id": "q", "text": "a"}\n{"_id": 3}\n{broken\n{"_id": "r", "text": "b"}\n')
    assert sorted(r.query_id for r in read_queries(spark, f"{tmp_path}/q.jsonl").collect()) == ["q", "r"]
    with pytest.warns(UserWarning, match="malformed"):
        assert malformed_lines(spark, f"{tmp_path}/q.jsonl") == ["{broken"]


def test_experiment(spark, tmp_path):
    lines = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
    (tmp_path / "corpus.jsonl").write_text(lines({"_id": f"c{i}", "title": f"name{i}", "text": f"word{i % 4} shared"} for i in range(10)))
    (tmp_path / "queries.jsonl").write_text(lines([{"_id": "good", "text": "name3"}, {"_id": "bad", "text": "year:[1 TO 2]"}, {"_id": "blank", "text": " "}, {"_id": "unjudged", "text": "shared"}]))
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\ngood\tc3\t1\nbad\tc1\t1\nblank\tc1\t1\n")
    done = run_folder(spark, str(tmp_path), commit_threshold=3)
    r = done.report.first()
    assert (r.queries, r.queries_judged, r.queries_skipped) == (3, 2, 1) and (r.ndcg_10, r.recall_10, r.mrr_10, r.map_100) == (0.5, 0.5, 0.5, 0.5)
    assert set(done.seconds) == {"index", "merge", "search"} and {x.query_id for x in done.run.collect()} == {"good", "unjudged"}
    with pytest.raises(ValueError):
        run_folder(spark, str(tmp_path / "none"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_reaches_the_files(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    index = create_index(spark, str(tmp_path), CONFIG, 4)
    index.writer.add_documents(docs(spark))
    index.writer.delete_by_id("d1")
    index.writer.close()
    snap = index.searcher.snapshot()
    single = plan(index.searcher.search("body:word1 number2", top_k=5))
    scans = [x for x in single.split("\n") if "FileScan" in x and "/postings" in x]
    assert scans and all("In(term, [number2,word1])" in x for x in scans)
    stored = [x for x in single.split("\n") if "FileScan" in x and "doc#" in x]
    assert len(stored) == 1 and "dynamicpruning" in stored[0]  # only segments with a hit are read
    many = plan(search_many(snap, spark.createDataFrame([("a", "word1"), ("b", "+number2 common")], "query_id string, text string"), CONFIG))
    scans = [x for x in many.split("\n") if "FileScan" in x and "/postings" in x]
    assert len(scans) == 1 and "In(term, [common,number2,word1])" in scans[0]
    assert "NestedLoop" not in many and "CartesianProduct" not in many
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_long_conditions_in_a_batch(spark):
    index = create_index(spark, None, CONFIG)
    index.writer.add_documents(docs(spark))
    index.writer.close()
    groups = [f"(number{i} word{i % 3} +(number{i + 1} common))" for i in range(9)]
    texts = {"long": " ".join(f"+{g}" for g in groups) + " " + " ".join(groups), "mixed": "+((+a0 +b0) (+number1 +word1)) " + " ".join(f"+((+x{i} +y{i}) (+common +title))" for i in range(12)), "plain": "number3"}
    got = {}
    for r in index.searcher.search_many(spark.createDataFrame(list(texts.items()), "query_id string, text string"), 20).collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    for q, text in texts.items():
        assert sorted(got.get(q, [])) == sorted((r.doc_id, round(r.score, 6)) for r in index.searcher.search(text, 20).collect())
    assert [d for d, _ in got["mixed"]] == ["d1"] and got["plain"]
