import pyarrow.parquet as pq
import regex
from pyspark.sql import functions as F

from lectern.functions import words

BREAK = regex.compile(r"(?V1)(?w)\b")
ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")


def slow_words(text):
    """UAX #29 word segments with a letter or numeral."""
    return [s for s in BREAK.split(text) if ALNUM.search(s)]


WITNESSES = {
    "Hello, wörld! It's 2026.": ["Hello", "wörld", "It's", "2026"],
    "don't don’t 3.14 12,5 a.b x_y a:b well-known": ["don't", "don’t", "3.14", "12,5", "a.b", "x_y", "a:b", "well", "known"],
    "漢字 ひら ½ x² ①": ["漢", "字", "ひ", "ら", "½", "x", "²", "①"],
    "_ __ a_ _b --": ["a_", "_b"],
    "été co­op": ["été", "co­op"],
    "": [],
    "abc123 1st 3a.b a.3": ["abc123", "1st", "3a.b", "a", "3"],
    "\u24b6 \u0345.": [],
}


def test_witnesses(spark):
    df = spark.createDataFrame([(t,) for t in WITNESSES], "t string").select("t", words.words(F.col("t")).alias("w"), words.count_words(F.col("t")).alias("n"), F.col("t").rlike(words.HAS_WORD).alias("any"))
    for r in df.collect():
        assert r.w == WITNESSES[r.t] and r.n == len(r.w) and r["any"] == bool(r.w), r.t


def test_documents_equal_the_standard(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", words.words(F.col("t")).alias("w"))
    for r in df.collect():
        assert r.w == slow_words(texts[r.i])
