"""Readability and density scores as formulas over summed counts. Null where a denominator is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = ("flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "average_sentence_length")


def readability(words: Column, sentences: Column, syllables: Column, complex_words: Column) -> list[Column]:
    """The four scores, named as in SCORES."""
    w, s = words.cast("double"), sentences.cast("double")
    asl = w / s
    per_word = syllables.cast("double") / w
    values = (
        F.lit(206.835) - F.lit(1.015) * asl - F.lit(84.6) * per_word,
        F.lit(0.39) * asl + F.lit(11.8) * per_word - F.lit(15.59),
        F.lit(0.4) * (asl + F.lit(100.0) * complex_words.cast("double") / w),
        asl,
    )
    return [F.when((words > 0) & (sentences > 0), v).alias(n) for n, v in zip(SCORES, values, strict=True)]


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))
