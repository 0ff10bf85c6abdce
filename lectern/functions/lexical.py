"""Syllables, complex words, lemmas and nominalizations of words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where letters are more, or fewer, syllables than their runs of vowels (fixed values).
ADDITIONS = r"(?s)[^aeioulr][lr]e[sd]?\z|[csgz]es\z|[td]ed\z|.y[aeiou]|ia(?!n\z)|eo|ism\z|[^aeiou]ire\z|[^gq]ua"
EXCEPTIONS = r"[^aeiou]e[sd]?\z|[^e]ely\z"
SYLLABIC_SUFFIX = r"(?:ing|ted|ded|ses|xes|zes|ches|shes|ces|ges)\z"
NOMINAL_SUFFIX = r"(?:tion|sion|ment|ance|ence|ity)\z"
LEAST_LETTERS = 7
#: Nouns with such an ending that aren't nominalizations (fixed values). The first thirty are the singular forms of
#: the stoplist of pybiber 0.3.1, copyright (c) 2025 David Brown, MIT License.
STOPLIST = (
    "apartment", "attention", "business", "capacity", "city", "comment", "condition", "document", "edition", "element",
    "environment", "experiment", "fiction", "function", "humanity", "identity", "mention", "moment", "motion", "nation",
    "notion", "pity", "position", "quality", "section", "solution", "station", "tradition", "university", "witness",
    "advance", "ambulance", "audience", "audition", "authority", "balance", "basement", "charity", "circumstance", "compliment",
    "conscience", "department", "influence", "instance", "mission", "occasion", "passion", "question", "science", "sentence",
    "session", "version",
)


def count_syllables(word: Column) -> Column:
    """At least 1: runs of vowels, and what the additions and exceptions change."""
    low = F.lower(word)
    n = F.regexp_count(low, F.lit("[aeiouy]+")) + F.regexp_count(low, F.lit(ADDITIONS)) - F.regexp_count(low, F.lit(EXCEPTIONS))
    return F.greatest(F.lit(1), n).cast("bigint")


def has_syllabic_suffix(word: Column) -> Column:
    return F.lower(word).rlike(SYLLABIC_SUFFIX)


def is_capitalized(word: Column) -> Column:
    return word.rlike(r"\A\p{IsUppercase}")


def is_complex(word: Column, initial: Column, syllables: Column | None = None) -> Column:
    """Three syllables or more, not counting an inflection's own; no name (a capital that doesn't begin the sentence)."""
    n = count_syllables(word) if syllables is None else syllables
    return ~(is_capitalized(word) & ~initial) & ((n - has_syllabic_suffix(word).cast("int")) >= 3)


def surface_lemma(word: Column) -> Column:
    """The lower-cased word without a possessive ending and a plural's; a rough lemma for want of a parser's."""
    low = F.regexp_replace(F.lower(word), r"(?:'s|’s|'|’)\z", "")
    return F.when(low.rlike(r"(?s).ies\z"), F.regexp_replace(low, r"ies\z", "y")).when(low.rlike(r"ss\z"), low).otherwise(F.regexp_replace(low, r"s\z", ""))


def is_nominalization(lemma: Column, stoplist: tuple[str, ...] = STOPLIST) -> Column:
    low = F.lower(lemma)
    long = F.length(F.regexp_replace(low, r"\P{IsAlphabetic}", "")) >= LEAST_LETTERS
    return low.rlike(NOMINAL_SUFFIX) & long & ~low.isin(*stoplist)


def is_nominal_word(word: Column) -> Column:
    """Whether a word's surface lemma is a nominalization. Words that hold no such ending are told by a plain search."""
    low = F.lower(word)
    may = low.contains("tion") | low.contains("sion") | low.contains("ment") | low.contains("ance") | low.contains("ence") | low.contains("ity") | low.contains("itie")
    return F.when(may, is_nominalization(surface_lemma(word))).otherwise(F.lit(False))


def parsed_lemma(form: Column, lemma: Column) -> Column:
    """A parser's lemma; where it gives `_`, the surface lemma of the form."""
    return F.when(lemma == "_", surface_lemma(form)).otherwise(lemma)
