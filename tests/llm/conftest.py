import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sample():
    """The smallest documents table as {doc_id: text}."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


#: (doc_id, text) rows with null, empty, wordless, repeated, tied and very long texts
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "same text"), (5, "same text"), (5, "same text"), (6, "same  text"), (7, "ab " * 60_000), (8, "x" * 50_000), (9, "é \U0001f600 漢字"), (10, "one")]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with columns whose names the operators use themselves."""
    rows = [(i, t, "a", "b", 1.0, "c") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, fp string, n double, key string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
