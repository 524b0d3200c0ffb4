"""Writer, stores, merge, stream, readers and metrics, and the library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from vellum.api import create_index
from vellum.config import IndexConfig, MergePolicy
from vellum.functions.analysis import standard_tokens, standard_words
from vellum.operators.evaluate import average_precision, ndcg, recall, reciprocal_rank
from vellum.sources.corpora import read_corpus, read_qrels, read_queries
from vellum.streaming.ingest import index_stream

CONFIG = IndexConfig(analyzers={"id": "keyword"}, no_store=("body",))
ROWS = [(f"d{i}", f"title {w}", f"body {w} common") for i, w in enumerate(["apple", "pear", "plum", "apple pear", "fig"])]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id string, title string, body string")


def found(index, text, **more):
    return [r.doc_id for r in index.searcher.search(text, **more).collect()]


def test_commit_delete_and_merge(spark, tmp_path):
    index = create_index(spark, str(tmp_path / "i"), CONFIG, commit_threshold=2, order_by=["id"], policy=MergePolicy(max_segments=2, merge_count=3))
    assert found(index, "apple") == []
    index.writer.add_documents(docs(spark))
    info = index.writer.commit()
    assert (info.segment_id, info.doc_count) == ("seg-000003", 1)
    assert sorted(found(index, "apple")) == ["d0", "d3"] and found(index, "id:d4") == ["d4"]
    assert "body" not in index.searcher.search("fig").schema["doc"].dataType.names
    index.writer.delete_by_id("d0")
    index.writer.commit()
    assert found(index, "apple") == ["d3"]
    again = create_index(spark, str(tmp_path / "i"), CONFIG)
    assert found(again, "apple") == ["d3"] and again.writer.commit().segment_id == ""
    assert index.merger.maybe_merge() is not None
    assert found(index, "apple") == ["d3"] and sorted(found(index, "common")) == ["d1", "d2", "d3", "d4"]
    index.merger.merge_all(full=True)
    assert len(index.searcher.store.manifest()) == 1 and sorted(found(index, "common")) == ["d1", "d2", "d3", "d4"]
    index.writer.close()
    index.writer.close()
    for late in (lambda: index.writer.add_documents(docs(spark)), index.writer.commit, lambda: index.writer.delete_by_id("d1")):
        with pytest.raises(RuntimeError, match="closed"):
            late()


def test_stream(spark, tmp_path):
    docs(spark).write.json(f"{tmp_path}/in")
    index = create_index(spark, str(tmp_path / "i"), CONFIG)
    stream = spark.readStream.schema("id string, title string, body string").json(f"{tmp_path}/in")
    for _ in range(2):
        index_stream(stream, index.searcher.store, CONFIG).awaitTermination()
        assert sorted(found(index, "apple")) == ["d0", "d3"]


def test_analyzers_agree(spark):
    texts = ["The quick-brown FOX_1", "café naïve", "", "a the I of", "x\ty\n42 4", "Ünïcode ßtraße K"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", standard_tokens(F.col("t")).alias("k"))
    assert {r.t: [(k.term, k.position) for k in r.k] for r in df.collect()} == {t: standard_words(t) for t in texts}


def test_readers(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "t", "text": "x"}\n\nnot json\n{"_id": "2", "title": "", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "old"}\n{"_id": "q", "text": "new"}\n{"_id": "r", "text": " "}\n')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t2\nq\t1\t1x\nq\t2\t0\nq\t3\n")
    assert sorted(map(tuple, read_corpus(spark, str(tmp_path / "corpus.jsonl")).collect())) == [("1", "t", "x"), ("2", "", "y")]
    assert list(map(tuple, read_queries(spark, str(tmp_path / "queries.jsonl")).collect())) == [("q", "new")]
    assert sorted(map(tuple, read_qrels(spark, str(tmp_path / "qrels.tsv")).collect())) == [("q", "1", 1), ("q", "2", 0)]


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    rels = spark.createDataFrame([("q", "b", 1), ("q", "d", 2)], "query_id string, doc_id string, rel int")
    value = lambda m: m(run, rels, 10, name="v").first()["v"]
    log3 = 1.584962500721156
    assert value(ndcg) == pytest.approx((1 / log3) / (3 + 1 / log3))
    assert [value(m) for m in (average_precision, recall, reciprocal_rank)] == [0.25, 0.5, 0.5]


def test_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/vellum", tmp_path / "vellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
