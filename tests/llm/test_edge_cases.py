"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from vellum.llm import decontam, fingerprint, hamming_dedup, html_bp, langid_crf, line_chunks, lpf_dedup, packing, quality_fm

CLASH = "row string, id int, hash string, chunk string, digest string, body string, anchor string, spans string, bucket string, length string, gone string, chunks string, keep string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"
LONG = " ".join(f"word{i}" for i in range(60_000))
SAME = "one two three\nfour five six\nseven eight nine\n" * 3 + "ten"


def rows():
    tail = ("r", 1, "h", "c", "d", "b", "a", "s", "bu", "le", "g", "ch", "k")
    base = [
        (1, SAME, "en", "a", len(SAME)), (1, SAME, "en", "a", len(SAME)), (2, SAME, "en", None, None), (3, None, "en", "a", 0), (4, "", None, "b", 0), (5, "  \n \t", "fr", "b", 4),
        (6, LONG, "de", "c", len(LONG)), (None, SAME, "en", "a", 1), (None, None, None, None, None), (7, "!!! ???", "en", "a", 7), (8, "lone", "en", "a", 4), (9, "\x00 nul \U0001f600 ünï", "de", "a", 3), (2, "another text of the same id", "en", "z", 5),
    ]
    return [b + (tail if i % 2 else (None,) * len(tail)) for i, b in enumerate(base)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(500, 540))), (None, None), (2, ""), (2, "lone"), (3, SAME)], "item_id bigint, text string")


def keep_all(docs, changed):
    out = changed.collect()
    assert changed.schema.names == docs.schema.names
    return out


def test_line_dedup(odd, none):
    out = keep_all(odd, line_chunks.line_dedup(odd))
    assert len(out) == len(rows())
    null = [r for r in out if r.doc_id is None and r.text is not None]
    assert [r.text for r in null] != [""]  # null ids sort first: the first copy
    ones = [r.text for r in out if r.doc_id == 1]
    assert len(ones) == 2 and ones[0] == ones[1]
    assert [r.text for r in out if r.doc_id == 6] == [LONG]
    assert sorted(str(r.text) for r in out if r.doc_id in (3, 4, 5)) == ["", "  \n \t", "None"]
    assert line_chunks.line_dedup(none).count() == 0


def test_repeated_spans(odd, none):
    out = keep_all(odd, lpf_dedup.remove_repeats(odd, min_words=6, gram=3))
    assert len(out) == len(rows())
    assert [r.text for r in out if r.doc_id == 6] == [LONG]
    ones = [r.text for r in out if r.doc_id == 1]
    assert len(ones) == 2 and ones[0] == ones[1] == ""
    first = next(r.text for r in out if r.doc_id is None and r.text)
    assert first.startswith("one two three\nfour five six\nseven eight nine") and len(first) < len(SAME)
    assert lpf_dedup.removed_repeats(none).count() == 0


def test_near_dedup(odd, none):
    out = keep_all(odd, hamming_dedup.near_dedup(odd))
    assert sorted(str(r.doc_id) for r in out if r.text == SAME) == ["None"]
    assert len(out) == len(rows()) - 3
    assert hamming_dedup.near_groups(none).count() == 0 and hamming_dedup.near_dedup(none).count() == 0


def test_fingerprints(odd, none):
    out = fingerprint.fingerprint_groups(odd).collect()
    assert len(out) == len(rows())
    assert sorted((r.doc_id or 0, r.keeper_doc_id, r.is_copy) for r in out if r.group_size == 4) == [(0, 1, True), (1, 1, False), (1, 1, False), (2, 1, True)]
    assert sorted((r.doc_id, r.keeper_doc_id) for r in out if r.group_size == 2) == [(4, 4), (5, 4)]
    assert fingerprint.fingerprint_groups(none).count() == 0


def test_decontamination(spark, odd, none, bench):
    found = {(r.doc_id, r.item_id, r.match_words, r.doc_word, r.item_word) for r in decontam.benchmark_matches(odd, bench).collect()}
    assert (6, 1, 40, 500, 0) in found and {d for d, i, *_ in found if i == 3} == {None, 1, 2}
    assert not {i for _, i, *_ in found} - {1, 3}
    out = keep_all(odd, decontam.decontaminate(odd, bench))
    assert sorted(str(r.doc_id) for r in out) == ["2", "3", "4", "5", "7", "8", "9", "None"]
    assert decontam.decontaminate(none, bench).count() == 0 and decontam.decontaminate(odd, bench.limit(0)).count() == len(rows())


def test_language_id(odd, none):
    model = langid_crf.train([("en", "the and of that with this from"), ("de", "der die das und nicht ist mit")], steps=20, sequences=100)
    out = langid_crf.identify(odd, model).collect()
    assert len(out) == len(rows())
    assert all(r.lang_pred is None and not r.keep and r.spans == [] for r in out if r.doc_id in (3, 4, 5, 7))
    assert next(r.n_words for r in out if r.doc_id == 6) == 60_000
    assert langid_crf.keep_identified(odd, model).schema.names == odd.schema.names
    assert langid_crf.identify(none).count() == 0
    assert langid_crf.train([]).labels == ["und"]
    assert langid_crf.training_rows(odd.drop("lang")) == [] and langid_crf.training_rows(none) == []
    chosen = langid_crf.training_rows(odd, 2)
    assert {x for x, _ in chosen} == {"en", "de", "fr"} and all(sum(x == y for x, _ in chosen) <= 2 for y, _ in chosen)
    assert langid_crf.keep_identified(odd).count() > 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (8, 0, 1), (None, 1, 0), (9, None, None), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality_fm.fit(odd, labels)
    out = quality_fm.score(odd, model).collect()
    assert len(out) == len(rows()) and all(0 <= r.quality_score <= 1 for r in out)
    assert len({r.quality_score for r in out if r.doc_id == 1}) == 1
    assert quality_fm.score(none, quality_fm.fit(none, labels)).count() == 0
    assert {r.quality_score for r in quality_fm.score(odd, quality_fm.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_packing(odd, none):
    out = packing.pack(odd, capacity=100).collect()
    assert sum(len(r.pieces) for r in out) == len(rows()) + 599 and sum(r.used == 100 for r in out) >= 600
    assert sorted((str(r.doc_ids[0]), r.pieces[0].text or "") for r in out if r.window_id is None) == [("3", ""), ("4", ""), ("5", "  \n \t"), ("None", "")]
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, capacity=0)


def test_html(spark):
    schema = "page_id bigint, url string, html string, text string, id int"
    data = [(1, "http://x/1", "<p>hello <b>big</b> world", None, 1), (2, None, None, "t", 2), (3, "", "", None, None), (None, "u", "a < b &amp; <", None, None), (4, "u", "<div " * 200 + "x", None, 3), (5, "u", "<b>" * 3000 + "deep", None, 4), (1, "http://x/1", "<p>hello <b>big</b> world", None, 1), (6, "u", "<!-- open", None, 1), (7, "u", "</p></div><script>var x", None, 1)]
    pages = spark.createDataFrame(data, schema)
    out = {(r.page_id, r.text, r.n_texts) for r in html_bp.extract(pages, html_bp.train([])).collect()}
    assert {(1, "hello big world", 3), (2, "", 0), (3, "", 0), (None, "a < b & <", 1), (5, "deep", 1), (6, "", 0), (7, "", 0)} <= out
    clash = "source_id int, page int, page_id int, source string, html string, h int"
    docs = spark.createDataFrame([(1, "hello", 5, 1, 1, "s", "h", 1), (1, "other", 5, 1, 1, "s", "h", 1), (None, None, 1, 1, 1, "s", "h", 1)], f"doc_id bigint, text string, {clash}")
    assert html_bp.labelled_pages(pages, docs) == [(data[0][2], "hello")]
    assert html_bp.extract(pages.limit(0), html_bp.train([])).count() == 0


def test_stages(spark, odd, none, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.schema.names == docs.schema.names or name == "packing"
            out.count()
