"""Queries against their SQL on documents that the given tables don't have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from tests.test_queries import rows

#: With words; without a character, a word, or anything but blanks.
TEXTS = ("One sentence here. Another famous one, with information and governance.", "", "!!! ... --", "  ", "\n", " \n \n", "Last one.\n", "First of all, no end")


def prose(words, sentences, syllables):
    """A text with these counts: words of one syllable, and as many of two as it takes."""
    two, each = syllables - words, words // sentences
    w = ["into" if k < two else "go" for k in range(words)]
    return " ".join(" ".join(w[k : k + each]).capitalize() + "." for k in range(0, words, each))


#: Documents with a score all but half-way between two of six places.
HALFWAY = ((0, prose(384, 8, 435)), (1, prose(384, 64, 607)), (2, prose(384, 2, 645)))


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives its SQL's rows on documents (doc_id, text)."""

    def compare(name, documents):
        ids, texts = zip(*documents, strict=True)
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
        db = duckdb.connect()
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        df, want = __spark_entry__.queries()[name](spark, str(tmp_path)), db.sql(__spark_entry__.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        a, b = rows(df.columns, map(tuple, df.collect())), rows(want.columns, want.fetchall())
        assert a == b and a

    return compare


def test_document_readability_of_documents_without_words(same):
    same("document_readability", [*enumerate(TEXTS), (len(TEXTS), None)])


def test_document_readability_between_two_places(same):
    same("document_readability", HALFWAY)


def test_metrics_json_of_documents_without_words(same):
    same("metrics_json", [*enumerate(TEXTS), (len(TEXTS), None)])


def test_metrics_json_between_two_places(same):
    same("metrics_json", HALFWAY)


def test_plain_blocks_of_documents_without_blocks(same):
    same("plain_blocks", [*enumerate(TEXTS), (len(TEXTS), None)])


def test_summary_table_of_documents_without_words(same):
    same("summary_table", [*enumerate(TEXTS), (len(TEXTS), None)])
