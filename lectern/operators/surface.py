"""The surface pipeline: documents, blocks, sentences, words, counts and scores. All of it runs in the JVM.

These operators read plain text. Documents in Markdown, and source positions, come from `operators.segment`, whose
sentences have the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexical, scores, words

COUNTS = ("words", "sentences", "syllables", "complex_words")


def blocks(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, block_ix, block): the blocks of plain documents."""
    return docs.select(*keys, F.posexplode(words.plain_blocks(F.col("source"))).alias("block_ix", "block"))


def blocks_and_empty(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same, and a row 0 with a null block for a document that has none."""
    rows = docs.select(*keys, F.posexplode_outer(words.plain_blocks(F.col("source"))).alias("block_ix", "block"))
    return rows.withColumn("block_ix", F.coalesce("block_ix", F.lit(0)))


def sentences(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, sent_ix, sentence): the sentences of plain documents in order, over all blocks."""
    every = F.flatten(F.transform(words.plain_blocks(F.col("source")), lambda b: words.sentences(words.block_text(b))))
    return docs.select(*keys, F.posexplode(every).alias("sent_ix", "sentence"))


def word_rows(sentence_rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "sent_ix")) -> DataFrame:
    """(keys, word_ix, word)."""
    return sentence_rows.select(*keys, F.posexplode(words.words(F.col("sentence"))).alias("word_ix", "word"))


def word_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, words): the words of the documents' blocks. No shuffle: a document's words are counted where it is read."""
    per_block = F.transform(words.plain_blocks(F.col("source")), lambda b: F.size(words.words(words.block_text(b))))
    return docs.select(*keys, F.aggregate(per_block, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("words"))


def total(array: str, value: Callable[[Column], Column]) -> Column:
    """The sum of `value` over the elements of an array column."""
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + value(x).cast("bigint"))


def with_counts(rows: DataFrame) -> DataFrame:
    """`rows` (..., sentence) with words, syllables, complex_words and nominalizations of each sentence, null where it is null.

    Counted by array functions on the sentence's own row: words don't become rows, and nothing is shuffled.
    """
    per_word = F.transform(
        F.col("_words"),
        lambda w, i: F.struct(lexical.count_syllables(w).alias("n"), lexical.has_syllabic_suffix(w).cast("int").alias("suffix"), (lexical.is_capitalized(w) & (i > 0)).alias("name"), lexical.is_nominal_word(w).alias("nominal")),
    )
    # columns of their own, so that the arrays are made once and not again in every expression that uses them
    rows = rows.withColumn("_words", words.words(F.col("sentence"))).withColumn("_w", per_word)
    counts = {
        "words": F.array_size("_words").cast("bigint"),
        "syllables": total("_w", lambda x: x.n),
        "complex_words": total("_w", lambda x: ~x["name"] & (x.n - x.suffix >= 3)),
        "nominalizations": total("_w", lambda x: x.nominal),
    }
    return rows.withColumns(counts).drop("_words", "_w")


def scored(counts: DataFrame) -> DataFrame:
    """The counts with the four readability scores and the nominalization ratio."""
    c = [F.col(x) for x in COUNTS]
    return counts.select("*", *scores.readability(*c), scores.ratio(F.col("nominalizations"), F.col("words")).alias("nominalization_ratio"))


def sentence_metrics(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and scores of each sentence that has a word. No shuffle: a sentence is counted where it is read."""
    rows = with_counts(sentences(docs, keys).where(F.col("sentence").rlike(words.HAS_WORD)))
    return scored(rows.select(*keys, "sent_ix", "words", F.lit(1).cast("bigint").alias("sentences"), "syllables", "complex_words", "nominalizations"))


def document_metrics(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and scores of each document, as formulas over summed counts; also of documents without a sentence, whose
    counts are 0 and whose scores are null. Documents that share their keys are summed up as one."""
    return group_metrics(docs, keys)


def group_metrics(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The same pooled over any grouping of the documents, e.g. by language. All counts are sums, so tasks combine them before
    the shuffle."""
    every = F.flatten(F.transform(words.plain_blocks(F.col("source")), lambda b: words.sentences(words.block_text(b))))
    # outer: a document without a sentence stays as a row
    rows = with_counts(docs.select(*keys, F.posexplode_outer(every).alias("sent_ix", "sentence")))
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    found = rows.groupBy(*keys).agg(
        F.count_if(F.coalesce("sent_ix", F.lit(0)) == 0).alias("prose_spans"),
        summed("words"),
        F.count_if(F.col("words") > 0).alias("sentences"),
        summed("syllables"),
        summed("complex_words"),
        summed("nominalizations"),
    )
    return scored(found)
