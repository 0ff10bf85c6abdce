"""A corpus made ready for training: five stages over `documents`, each of one operator.

A document is told by its doc_id and its text: rows equal in both stay or go together, and a null doc_id, which is larger
than any other, stands for as many documents as it has texts. All stages but the last return the columns of `documents`,
leave out any others, keep repeated rows apart from what they decide, and give no rows for an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, langid, packing, pii, simhash
from lectern.llm.common import join_checked, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a document that its main language must have.
LEAST_SHARE = 0.5
#: Words of a shingle, and the least similarity of near copies as a fraction.
WORDS, ALIKE = 5, (4, 5)
#: The surrogates' key where `run` gets none. A user passes a secret key of their own.
KEY = b"a key for tests"


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a `key` that is never null: it orders by doc_id, nulls last, then by a hash of the text."""
    return docs.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))


def without(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """`docs` (with key) but for those of which no row of `keep` (key, keep) says true. Texts stay where they are while the others are few."""
    none, number, text = F.col("key.none").alias("none"), F.coalesce("key.id", F.lit(0)).alias("number"), F.col("key.text").alias("hash")
    gone = keep.groupBy("key").agg(F.max("keep").alias("keep")).where("not keep").select(none, number, text)
    rows = docs.select(*COLUMNS, none, number, text)
    return join_checked(rows, gone, ["none", "number", "hash"], "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets `lang` to the language found; rejects texts without a letter (null and empty ones are such), and mixtures
    without a main language. Texts of any length are read whole; of languages that tie the first by name is found; where
    no row has a `lang` to learn from, all are rejected."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs, model, carry=COLUMNS)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts, white space apart. Null and empty texts equal each other; of equal texts
    without a doc_id the smallest hash stays; texts of any length are compared whole."""
    docs = keyed(docs)
    return without(docs, exact_dedup.exact_dedup(docs, "key").select("key", F.col("kept").alias("keep")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts linked by a Jaccard similarity of 0.8 or more of their five-word
    shingles. Null, empty and wordless texts are a group; a text of under five words is one shingle; long texts count whole;
    of a group without a doc_id the smallest hash stays."""
    docs = keyed(docs)
    found = simhash.near_duplicates(docs, "key", k=WORDS, least=ALIKE)
    return without(docs, found.select("key", (F.col("component_id") == F.col("key")).alias("keep")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str, key: bytes = KEY) -> DataFrame:
    """Replaces personal data in `text` and counts `n_chars` anew. A null text stays null, and so does its n_chars; no row goes."""
    out = pii.pseudonymise(docs, key, carry=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into training sequences, one row per piece. A null or empty text is one piece, its end token;
    longer ones than a sequence are cut; every row is packed, null and repeated ids too."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]
#: Languages, similarities and surrogates can't be expressed in SQL.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark keeps it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str, key: bytes = KEY) -> DataFrame:
    """All stages over `documents`, with `key` for the surrogates. Between stages the documents are Parquet files in the
    shared checkpoint folder, deleted when the next are written; the last are deleted with their folder once the last
    stage, which works from checkpoints of its own, has read them."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        (stage(spark, docs, sf_dir, key) if stage is private else stage(spark, docs, sf_dir)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)
    return out
