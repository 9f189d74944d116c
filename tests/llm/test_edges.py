"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinloom.llm import decontaminate, language, licenses, lines, pieces, quality, simhash, spotsigs, toxicity, wordpiece
from twinloom.llm.queries import PIECES

LONG = "the quick word and " * 30_000
ROWS = [(1, "plain text of a few words here", "en"), (2, None, "en"), (None, "no key at all in this row", "en"), (3, "", "de"), (4, LONG, "en"), (1, "plain text of a few words here", "en"), (5, "plain text of a few words here", None), (6, " \n\t\n ", "fr"), (7, "▁ é\U0001f600\n\nend", "fr"), (8, "\x00nul\x00 byte", "de")]
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["k", "t", "s", "fp", "score", "words", "line", "__k", "__drop", "y", "h", "n_lines", "piece_ids", "r", "p", "key", "w"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return d.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "plain text of a few words here"), (2, None), (3, ""), (4, "one")], "item_id long, text string")


def operators(spark, labels, items):
    model = pieces.load(PIECES)
    vocabulary = wordpiece.pieces_of(PIECES)
    every = F.lit(True)
    return {
        "quality": lambda d: quality.score(d, quality.train(d, labels, every)),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels, every)),
        "simhash": simhash.near_duplicates,
        "licenses": licenses.scan_licenses,
        "pieces": lambda d: pieces.decode(pieces.encode(d, model), model),
        "digests": lambda d: pieces.digests(d, model),
        "wordpiece": lambda d: wordpiece.token_counts(d, vocabulary),
        "spotsigs": spotsigs.edited_with_next,
        "language": lambda d: language.predict(d, language.train(d, every)),
        "lines": lambda d: lines.dedup_lines(d, counts=True),
    }


NAMES = ["quality", "toxicity", "simhash", "licenses", "pieces", "digests", "wordpiece", "spotsigs", "language", "lines"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_stay(spark, docs, labels, items, name):
    out = operators(spark, labels, items)[name](docs)
    rows = out.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in ROWS), key=str)
    if "score" in out.columns and name != "lines" and name != "pieces":
        assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, items, name):
    assert operators(spark, labels, items)[name](docs.limit(0)).count() == 0


def test_no_labels(spark, docs, labels):
    none = labels.limit(0)
    assert quality.score(docs, quality.train(docs, none, F.lit(True))).count() == len(ROWS)
    assert toxicity.score(docs, toxicity.train(docs, none, F.lit(True))).count() == len(ROWS)


def test_leaks(spark, docs, items):
    got = decontaminate.leaks(docs, items).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 5] and {r.item_id for r in got} == {1}
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.clean_rows(docs, items).count() == len(ROWS) - 3


def test_lossless(spark, docs, labels, items):
    model = pieces.load(PIECES)
    out = pieces.decode(pieces.encode(docs, model), model)
    assert all((r.text or "") == r.decoded for r in out.collect())
    assert out.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "piece_ids"]


def test_defined_values(spark, docs, labels, items):
    ops = operators(spark, labels, items)
    lang = {(r.doc_id, r.lang_pred, r.score) for r in ops["language"](docs).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (6, "und", 0.0)} <= lang
    found = {r.doc_id: r for r in licenses.digest(ops["licenses"](docs)).collect()}
    assert (found[2].n_words, found[2].n_base, found[2].first_word, found[2].base_labels, found[2].score) == (0, 0, None, "", 0.0)
    sim = {(r.doc_id, r.fp, r.component_id) for r in ops["simhash"](docs).collect()}
    assert {(2, 0, 2), (3, 0, 2), (6, 0, 2)} <= sim and {c for d, _, c in sim if d in (1, 5)} == {1}
    line = {(r.doc_id, r.text) for r in ops["lines"](docs).collect()}
    assert {(1, ROWS[0][1]), (5, ""), (2, None), (None, ROWS[2][1]), (6, ROWS[7][1])} <= line


def test_stages_on_edges(spark, docs, items, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() <= len(ROWS)
        assert name == "pieces" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
