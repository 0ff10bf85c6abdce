"""The engine's functions by name in Spark SQL: temporary SQL functions, so that they stay JVM expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lectern.functions import lexical, words


def _text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _count(text: str, pattern: str) -> str:
    return f"regexp_count({text}, {_text(pattern)})"


def _sentences() -> str:
    text = "block"
    for function, found, put in words.MARKING:
        text = f"{function}({text}, {_text(found)}, {_text(put)})"
    return f"filter(transform(split({text}, {_text(chr(1))}), s -> btrim(s, {_text(words.WHITE)})), s -> s RLIKE {_text(words.ALPHANUMERIC)})"


def definitions() -> dict[str, str]:
    """Signature and body of each function."""
    stop = ", ".join(map(_text, lexical.STOPLIST))
    plural = f"regexp_replace(lower(word), {_text(r'''(?:'s|’s|'|’)\z''')}, '')"
    return {
        "text_words(text STRING) RETURNS ARRAY<STRING>": f"filter(regexp_extract_all(text, {_text(words.WORD)}, 0), w -> w RLIKE {_text(words.ALPHANUMERIC)})",
        "text_sentences(block STRING) RETURNS ARRAY<STRING>": _sentences(),
        "count_words(text STRING) RETURNS BIGINT": "size(text_words(text))",
        "count_syllables(word STRING) RETURNS BIGINT": f"greatest(1, {_count('lower(word)', '[aeiouy]+')} + {_count('lower(word)', lexical.ADDITIONS)} - {_count('lower(word)', lexical.EXCEPTIONS)})",
        "is_complex(word STRING, initial BOOLEAN) RETURNS BOOLEAN": f"NOT (word RLIKE {_text(chr(92) + 'A' + chr(92) + 'p{IsUppercase}')} AND NOT initial) AND count_syllables(word) - CAST(lower(word) RLIKE {_text(lexical.SYLLABIC_SUFFIX)} AS INT) >= 3",
        "surface_lemma(word STRING) RETURNS STRING": f"CASE WHEN {plural} RLIKE {_text(r'(?s).ies\z')} THEN regexp_replace({plural}, {_text(r'ies\z')}, 'y') WHEN {plural} RLIKE {_text(r'ss\z')} THEN {plural} ELSE regexp_replace({plural}, {_text(r's\z')}, '') END",
        "is_nominalization(lemma STRING) RETURNS BOOLEAN": f"lower(lemma) RLIKE {_text(lexical.NOMINAL_SUFFIX)} AND length(regexp_replace(lower(lemma), {_text(r'\P{IsAlphabetic}')}, '')) >= {lexical.LEAST_LETTERS} AND lower(lemma) NOT IN ({stop})",
        "flesch_reading_ease(words BIGINT, sentences BIGINT, syllables BIGINT) RETURNS DOUBLE": "CASE WHEN words > 0 AND sentences > 0 THEN 206.835D - 1.015D * (words / sentences) - 84.6D * (syllables / words) END",
    }


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in definitions()]
