"""Documents: files of prose, their format, and tables that already hold texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKDOWN, PLAIN = "markdown", "plain"


def source_format(path: Column) -> Column:
    """`markdown` for the extensions md and markdown in any case, else `plain`. A name that is all extension has none."""
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))
    return F.when(extension.isin("md", "markdown"), MARKDOWN).otherwise(PLAIN)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, source, format, status) for each file of the paths (files, folders or patterns). Where it isn't UTF-8, `source`
    is null and `status` is `unreadable`; a path where nothing is has a row with the status `missing`. The others are read."""
    there = [p for p in paths if _exists(spark, p)]
    gone = spark.createDataFrame([(p,) for p in paths if p not in there], "path string").select("path", F.lit(None).cast("string").alias("source"), source_format(F.col("path")).alias("format"), F.lit("missing").alias("status"))
    if not there:
        return gone
    raw = spark.read.format("binaryFile").load(there)
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    read = raw.select("path", F.when(ok, F.col("content").cast("string")).alias("source"), source_format(F.col("path")).alias("format"), F.when(ok, "ok").otherwise("unreadable").alias("status"))
    return read.union(gone)


def from_table(df: DataFrame, id_col: str, text_col: str, format: str = PLAIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, format, *keep): documents that are rows of a table."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("source"), F.lit(format).alias("format"), *keep)


def spread(docs: DataFrame, *keys: str) -> DataFrame:
    """`docs` dealt by `keys` to all cores where its scan would keep less than half of them busy, as with one small file or
    row group; as it is otherwise, so large inputs aren't shuffled. What is grouped by the keys later needs no second shuffle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores, *keys) if 2 * docs.rdd.getNumPartitions() <= cores else docs
