"""The surface pipeline in the SQL of DuckDB, for comparison with the operators.

RE2 has no look-around, so some replacements run twice where their matches could overlap; scripts without spaces are
left out here. Both agree on texts in Latin script.
"""

from __future__ import annotations

from lectern.functions.lexical import STOPLIST
from lectern.functions.words import ABBREVIATIONS

_M = r"[\p{Mn}\p{Me}\p{Mc}]*"
_L, _D = rf"[\p{{L}}\p{{Nl}}]{_M}", rf"\p{{Nd}}{_M}"
_MID, _MIDNUM = "[:·.''‘’․﹒＇．]", "[,;.''‘’․﹒＇．]"
WORD = rf"(?:{_L}(?:{_MID}{_L})*|{_D}(?:{_MIDNUM}{_D})*|\p{{Pc}})+"
_CLOSE, _SPACE, _OTHER = r"""[\p{Ps}\p{Pe}\p{Pi}\p{Pf}"'']*""", r"\s*", r"[^\p{L}\p{Nl}.!?\x02\x03\x04]*"


def _replace(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, '{pattern}', {by}, 'g')"


def words(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{WORD}'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))"


def pieces(text: str) -> str:
    """The text's segments with the blanks around them; line breaks are blanks."""
    t = f"translate({text}, chr(10) || chr(13), '  ')"
    t = _replace(t, rf"\.({_CLOSE}{_SPACE}{_OTHER}\p{{Ll}})", r"chr(2) || '\1'")
    t = _replace(t, r"\.(\p{Nd})", r"chr(2) || '\1'")
    for _ in range(2):
        t = _replace(t, r"(\p{L})\.(\p{Lu})", r"'\1' || chr(2) || '\2'")
    for stop, mark in ((r"\.", 2), ("!", 3), (r"\?", 4)):
        t = _replace(t, rf"{stop}({_CLOSE}{_SPACE}[,;:\-–—、，])", rf"chr({mark}) || '\1'")
    t = _replace(t, rf"([.!?\x02\x03\x04]*[.!?](?:{_CLOSE}{_SPACE}[.!?]+)*{_CLOSE}{_SPACE})", r"'\1' || chr(1)")
    t = f"translate({t}, chr(2) || chr(3) || chr(4), '.!?')"
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    for _ in range(2):
        t = _replace(t, rf"(^|[\s\x01])([^\p{{L}}\p{{N}}\s\x01]*(?:{known})\s*)\x01", r"'\1\2'")
    return f"string_split({t}, chr(1))"


def sentences(text: str) -> str:
    return f"list_filter(list_transform({pieces(text)}, lambda s: trim(s)), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))"


def syllables(word: str) -> str:
    low = f"regexp_replace(lower({word}), 'ian$', 'i#n')"
    n = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
    add = r"[^aeioulr][lr]e[sd]?$|[csgz]es$|[td]ed$|.y[aeiou]|ia|eo|ism$|[^aeiou]ire$|[^gq]ua"
    return f"greatest(1, {n(f'lower({word})', '[aeiouy]+')} + {n(low, add)} - {n(f'lower({word})', '[^aeiou]e[sd]?$|[^e]ely$')})"


def is_complex(word: str, initial: str, n: str) -> str:
    return f"(NOT (regexp_matches({word}, '^\\p{{Lu}}') AND NOT {initial}) AND {n} - CAST(regexp_matches(lower({word}), '(?:ing|ted|ded|ses|xes|zes|ches|shes|ces|ges)$') AS INT) >= 3)"


def surface_lemma(word: str) -> str:
    low = f"regexp_replace(lower({word}), '(?:''s|’s|''|’)$', '')"
    return f"CASE WHEN regexp_matches({low}, '.ies$') THEN regexp_replace({low}, 'ies$', 'y') WHEN regexp_matches({low}, 'ss$') THEN {low} ELSE regexp_replace({low}, 's$', '') END"


def is_nominalization(lemma: str) -> str:
    stop = ", ".join(f"'{s}'" for s in STOPLIST)
    return f"(regexp_matches({lemma}, '(?:tion|sion|ment|ance|ence|ity)$') AND length(regexp_replace({lemma}, '\\P{{L}}', '', 'g')) >= 7 AND {lemma} NOT IN ({stop}))"


def sentence_rows(keys: str = "doc_id", table: str = "documents") -> str:
    """CTEs up to `sent` (keys, sent_ix, sentence)."""
    return f"""listed AS (SELECT {keys}, {sentences('text')} AS s FROM {table}),
sent AS (SELECT {keys}, unnest(range(len(s))) AS sent_ix, unnest(s) AS sentence FROM listed)"""


def word_rows(keys: str = "doc_id", table: str = "documents") -> str:
    """CTEs up to `word` (keys, sent_ix, word_ix, word, n: its syllables, lemma)."""
    return f"""{sentence_rows(keys, table)},
split AS (SELECT {keys}, sent_ix, {words('sentence')} AS w FROM sent),
word0 AS (SELECT {keys}, sent_ix, unnest(range(len(w))) AS word_ix, unnest(w) AS word FROM split),
word AS (SELECT *, {syllables('word')} AS n, {surface_lemma('word')} AS lemma FROM word0)"""


COUNTS = f"""count(*) AS words, count(*) FILTER (word_ix = 0) AS sentences, CAST(sum(n) AS BIGINT) AS syllables,
count(*) FILTER ({is_complex('word', '(word_ix = 0)', 'n')}) AS complex_words, count(*) FILTER ({is_nominalization('lemma')}) AS nominalizations"""

#: Over columns words, sentences, syllables, complex_words; rounded, as engines may differ in the last place.
SCORES = """round(206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syllables / words), 6) AS flesch_reading_ease,
round(0.39::DOUBLE * (words / sentences) + 11.8::DOUBLE * (syllables / words) - 15.59::DOUBLE, 6) AS flesch_kincaid_grade,
round(0.4::DOUBLE * (words / sentences + 100 * complex_words / words), 6) AS gunning_fog,
round(words / sentences, 6) AS average_sentence_length, round(nominalizations / words, 6) AS nominalization_ratio"""


def metrics(keys: str, extra: str = "", spans: str = "", table: str = "documents", inner: str | None = None) -> str:
    """Counts and scores by `keys`."""
    inner = inner or keys
    return f"WITH {word_rows(inner, table)},\nc AS (SELECT {keys}, {COUNTS} FROM word GROUP BY {keys}) SELECT {keys}, {spans}words, sentences, syllables, complex_words, nominalizations, {SCORES} FROM c{extra}"
