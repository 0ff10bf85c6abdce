from pyspark.sql import functions as F

from lectern.functions import lexical, words
from lectern.functions.register import register


def test_sql_functions_are_the_column_functions(spark):
    assert "count_syllables" in register(spark)
    texts = ["Don't panic: it's 3.14, well-known ½ 漢字!", "The Committee's nationalities, glasses and Cities' implementations"]
    spark.createDataFrame([(t,) for t in texts], "t string").createOrReplaceTempView("some_texts")
    df = spark.table("some_texts")
    assert [r.w for r in spark.sql("SELECT text_words(t) w FROM some_texts").collect()] == [r.w for r in df.select(words.words(F.col("t")).alias("w")).collect()]
    assert [r.s for r in spark.sql("SELECT text_sentences(t) s FROM some_texts").collect()] == [r.s for r in df.select(words.sentences(F.col("t")).alias("s")).collect()]
    (r,) = spark.sql("SELECT text_sentences('Dr. Li came at 3.14 p.m. sharp. \u201cWhy?\u201d she asked. No. 5!') s").collect()
    assert r.s == ["Dr. Li came at 3.14 p.m. sharp.", "\u201cWhy?\u201d", "she asked.", "No. 5!"]
    exploded = df.select(F.explode(words.words(F.col("t"))).alias("w"))
    exploded.createOrReplaceTempView("some_words")
    got = spark.sql("SELECT w, count_syllables(w) n, is_complex(w, false) c, surface_lemma(w) l, is_nominalization(surface_lemma(w)) m FROM some_words").collect()
    w = F.col("w")
    want = exploded.select("w", lexical.count_syllables(w).alias("n"), lexical.is_complex(w, F.lit(False)).alias("c"), lexical.surface_lemma(w).alias("l"), lexical.is_nominalization(lexical.surface_lemma(w)).alias("m")).collect()
    assert got == want and any(r.m for r in got)
    (r,) = spark.sql("SELECT flesch_reading_ease(100, 5, 150) a, flesch_reading_ease(0, 0, 0) b, count_words('a b') c").collect()
    assert abs(r.a - 59.635) < 1e-9 and r.b is None and r.c == 2
