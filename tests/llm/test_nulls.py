"""Null ids, and nulls in every other column, crash nothing and lose no row."""

import public_tokenizers
import pytest

import corpus_pipeline
from lectern.llm import bpe, exact_dedup, extract, langid, lzprint, packing, pii, quality, secrets, simhash

ROWS = [(None, "alone among the nulls", None, None, None), (None, None, None, None, None), (1, "the very same text", "en", "s", 18), (None, "the very same text", "en", None, 18), (2, "other words, other letters", None, "s", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


def test_row_operators(docs):
    model = langid.fit(docs)
    assert model.langs == ["en"]
    for out in (
        langid.identify(docs, model),
        secrets.scan_secrets(docs),
        pii.pseudonymise(docs, b"k"),
        bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True),
        lzprint.neighbour_likeness(docs),
        packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, public_tokenizers.PATTERN),
        quality.classify(docs, quality.fit(docs, docs.selectExpr("doc_id", "cast(null as int) quality"))),
    ):
        assert sorted((r.doc_id is None for r in out.collect())) == [False, False, True, True, True]


def test_exact_dedup(docs):
    out = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert out == sorted([(1, 1, 2, True), (None, 1, 2, False), (2, 2, 1, True), (None, None, 1, True), (None, None, 1, True)], key=str)


def test_simhash(docs):
    out = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert out == {(1, 1), (None, 1), (2, 2), (None, None)}


def test_pages(spark):
    df = spark.createDataFrame([(None, None, None), (1, None, "<p>Some words of a page.</p>")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.n_chars) for r in extract.extract(df).collect()) == [("1", 21), ("None", 0)]


def test_stages(spark, docs):
    """A null id stands for as many documents as it has texts: its copy of a document with an id goes, the others stay."""
    rows, texts = docs, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        rows = f(spark, rows, "")
        texts.append(sorted((str(r.doc_id), r.text) for r in rows.collect()))
    alone, same, other = ("None", "alone among the nulls"), "the very same text", ("2", "other words, other letters")
    assert texts[0] == sorted([alone, ("1", same), ("None", same), other])
    assert texts[1] == texts[2] == texts[3] == sorted([alone, ("1", same), other])
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == 3


def test_copies_without_any_id(spark, docs):
    a = "a text of some words that is long enough to be a near copy of another one, if but a word of it differs from that one in the end"
    rows = [(None, a), (None, a.replace(" ", "  ")), (None, a[:-3] + "END"), (3, a + " more"), (3, "another text of the same id")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    exact = corpus_pipeline.exact(spark, df, "")
    assert sorted((str(r.doc_id), " ".join(r.text.split())) for r in exact.collect()) == sorted([("None", a), ("None", a[:-3] + "END"), ("3", a + " more"), ("3", "another text of the same id")])
    near = corpus_pipeline.near(spark, exact, "")
    assert sorted((r.doc_id, r.text) for r in near.collect()) == [(3, a + " more"), (3, "another text of the same id")]
