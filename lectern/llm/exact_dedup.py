"""Exact dedup by progressive refinement: length, then a prefix's hash, then the whole text's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, cut, small, table


def normalised(text) -> F.Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of `df`: id, keep_id (smallest id of its equal texts), group_size, kept, text_sha256.

    1. Rows are counted by length of the normalised text and by a hash of its prefix; both counts combine before
       the shuffle, so a hot text or length costs a row per task. 2. Whole texts are hashed only where more than
       one row shares length and prefix; the surviving keys are broadcast if they are `broadcast_rows` at most,
       else every text is hashed in the same scan. Texts never travel. 3. Survivors group by the SHA-256.
       `text_sha256` is null for texts that no other equals, unless `digest_all`.

    Null and empty texts equal each other (and nothing but them); of repeated ids every row is returned and `kept`
    is true on each row that bears the smallest id; a null id is larger than any; an empty table gives no rows; other
    columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    keyed = docs.select("id", "norm", F.length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("p"))
    by_prefix = keyed.groupBy("n", "p").agg(F.count("*").alias("rows"))
    by_length = by_prefix.groupBy("n").agg(F.sum("rows").alias("of_length")).where("of_length > 1").select("n")
    alike = cut(by_prefix.where("rows > 1").join(by_length, "n", "left_semi").select("n", "p"))
    if small(alike, broadcast_rows):
        rows = keyed.join(F.broadcast(alike.withColumn("hit", F.lit(True))), ["n", "p"], "left")
    else:
        rows = keyed.withColumn("hit", F.lit(True))
    whole = F.sha2(F.col("norm").cast("binary"), 256)
    rows = rows.select("id", F.coalesce("hit", F.lit(False)).alias("hit"), (whole if digest_all else F.when(F.col("hit"), whole)).alias("sha"))
    rows = cut(rows)
    groups = cut(rows.where("hit").groupBy("sha").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    # single rows get keys of their own, else their nulls would all meet in one task
    rows = rows.withColumn("key", F.when(F.col("hit"), F.col("sha")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    groups = groups.select(F.col("sha").alias("key"), "keep_id", "group_size")
    out = rows.join(F.broadcast(groups) if small(groups, broadcast_rows) else groups, "key", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), (F.col("sha") if digest_all else F.when(F.col("group_size") > 1, F.col("sha"))).alias("text_sha256"))


def exact_dedup_query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


EXACT_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
FROM d
"""
