"""Words and sentences of a block of text, as Column expressions (Unicode text segmentation, UAX #29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common letters, which need no look-up of properties; the rest of a pattern is tried beyond ASCII only.
_COMMON = r"A-Za-zÀ-ÖØ-öø-ɏ"
_FAR = r"(?![\x00-\x7F])"
#: Marks that follow a letter or digit without ending its word.
_M = rf"(?:{_FAR}[\p{{M}}\p{{Cf}}&&[^\x{{200B}}]])*+"
#: Letters that aren't words of their own, as ideographs, Hiragana and the letters of scripts without spaces are.
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_L = rf"(?:[{_COMMON}]++|{_FAR}[\p{{L}}\p{{Nl}}&&[^{_ALONE}]]){_M}"
_D = rf"(?:[0-9]++|{_FAR}\p{{Nd}}){_M}"
_MID = r"[:·.'‘’․﹒＇．]"
_MIDNUM = r"[,;.'‘’․﹒＇．]"
#: A word: runs of letters, digits and connectors, one ideograph, or one other numeral.
WORD = rf"(?:{_L}(?:{_MID}{_L})*+|{_D}(?:{_MIDNUM}{_D})*+|_|{_FAR}\p{{Pc}})++|{_FAR}(?:[{_ALONE}]|\p{{No}}){_M}"
ALPHANUMERIC = rf"[{_COMMON}0-9]|{_FAR}[\p{{IsAlphabetic}}\p{{N}}]"
#: What a text with a word holds: every letter and numeral is part of one; other alphabetic characters may stand alone.
HAS_WORD = rf"[{_COMMON}0-9]|{_FAR}[\p{{L}}\p{{N}}]"

#: Abbreviations after which a sentence goes on (fixed values).
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.", "e.g.", "i.e.", "etc.", "vs.", "Fig.", "No.", "cf.")

_CLOSE = r"""[\p{Ps}\p{Pe}\p{Pi}\p{Pf}"']*"""
_SPACE = r"[\p{IsWhite_Space}]*"
#: Sentence ends other than the full stop, of the scripts in common use.
_STOPS = "!?。！？｡؟۔।॥‼⁇⁈⁉"
_OTHER = rf"[^\p{{L}}\p{{Nl}}.{_STOPS}\x02]*"
#: The characters of the property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def words(text: Column) -> Column:
    """array<string>: the text's words in order; a word has a letter or a numeral."""
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: w.rlike(ALPHANUMERIC))


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def _known() -> str:
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    return rf"(?<=\A|[\p{{IsWhite_Space}}\x01])([^\p{{IsAlphabetic}}\p{{N}}\p{{IsWhite_Space}}\x01]*(?:{names})[\p{{IsWhite_Space}}]*)\x01"


#: What marks sentence ends with `\x01`, in order, as (SQL function, what it finds, what it puts): full stops that end none, by
#: the rules SB6 to SB8, become `\x02` meanwhile; then what is left ends sentences (SB8a to SB11) if no comma or the like
#: follows, but not after an abbreviation.
MARKING = (
    ("translate", "\x01\x02", "\x05\x05"),
    ("regexp_replace", rf"\.({_CLOSE}{_SPACE}{_OTHER}\p{{Ll}})", "\x02$1"),
    ("regexp_replace", r"\.(?=\p{Nd})", "\x02"),
    ("regexp_replace", r"(?<=\p{L})\.(?=\p{Lu})", "\x02"),
    ("regexp_replace", rf"((?>[.{_STOPS}\x02]*[.{_STOPS}](?:{_CLOSE}{_SPACE}[.{_STOPS}]+)*{_CLOSE}{_SPACE})(?![,;:\-–—、，])|[\x{{85}}\x{{2028}}\x{{2029}}])", "$1\x01"),
    ("translate", "\x02", "."),
    ("regexp_replace", _known(), "$1"),
)


def marked(text: Column) -> Column:
    """The text with `\x01` after each of its sentences."""
    for function, found, put in MARKING:
        text = F.translate(text, found, put) if function == "translate" else F.regexp_replace(text, found, put)
    return text


def sentences(text: Column) -> Column:
    """array<string>: the sentences of a block's text, trimmed; those without a word are left out."""
    parts = F.transform(F.split(marked(text), "\x01"), lambda s: F.btrim(s, F.lit(WHITE)))
    return F.filter(parts, lambda s: s.rlike(ALPHANUMERIC))


def plain_blocks(source: Column) -> Column:
    """array<string>: the runs of lines that aren't blank, without their last line break."""
    ws = r"[^\S\n]"
    parts = F.split(F.regexp_replace(source, rf"(?U)\A(?:{ws}*\n)+", ""), rf"(?U)\n(?:{ws}*\n)+")
    parts = F.transform(parts, lambda b: F.regexp_replace(F.regexp_replace(b, rf"(?U)\n{ws}*\z", ""), r"\r\z", ""))
    return F.filter(parts, lambda b: b.rlike(r"[^\p{IsWhite_Space}]"))


def block_text(block: Column) -> Column:
    """A span's text as it stands in its block: each line feed and carriage return is a space."""
    return F.translate(block, "\n\r", "  ")
