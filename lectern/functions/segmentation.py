"""Blocks, sentences and positions of one document, with byte offsets: the Python side of `operators.segment`."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import regex

from lectern.functions import markdown
from lectern.functions.words import ABBREVIATIONS

_EF = r"[\p{SB=Extend}\p{SB=Format}]*"
_END = regex.compile(rf"([\p{{SB=ATerm}}\p{{SB=STerm}}]){_EF}(?:\p{{SB=Close}}{_EF})*(?:\p{{SB=Sp}}{_EF})*(?:\r\n|[\p{{SB=Sep}}\p{{SB=CR}}\p{{SB=LF}}])?|\r\n|[\p{{SB=Sep}}\p{{SB=CR}}\p{{SB=LF}}]")
_SEPARATOR = regex.compile(r"[\p{SB=Sep}\p{SB=CR}\p{SB=LF}]")
_FULL_STOP = regex.compile(r"\p{SB=ATerm}")
_NUMERIC, _UPPER, _CASED, _MARK = (regex.compile(p) for p in (r"\p{SB=Numeric}", r"\p{SB=Upper}", r"[\p{SB=Upper}\p{SB=Lower}]", r"[\p{SB=Extend}\p{SB=Format}]"))
_GOES_ON = regex.compile(r"[\p{SB=SContinue}\p{SB=ATerm}\p{SB=STerm}]")
_LOWER_FIRST = regex.compile(r"[^\p{SB=OLetter}\p{SB=Upper}\p{SB=Lower}\p{SB=Sep}\p{SB=CR}\p{SB=LF}\p{SB=ATerm}\p{SB=STerm}]*+\p{SB=Lower}")
_DIRECT = regex.compile(rf"[\p{{SB=ATerm}}]{_EF}\Z")
_LEADING = regex.compile(r"\A[^\p{Alphabetic}\p{N}]+")
_WORDLIKE = regex.compile(r"[\p{Alphabetic}\p{N}]")
_WHITE = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def _after_letter(text: str, at: int) -> bool:
    """Whether a cased letter, and what marks it has, stand before `at`."""
    while at and _MARK.match(text, at - 1):
        at -= 1
    return at > 0 and _CASED.match(text, at - 1) is not None


def _last_token(text: str, start: int, end: int) -> str:
    """The last run in text[start:end] without white space; '' if there is none."""
    while end > start and text[end - 1] in _WHITE:
        end -= 1
    at = end
    while at > start and text[at - 1] not in _WHITE:
        at -= 1
    return text[at:end]


def segments(text: str) -> list[tuple[int, int]]:
    """Sentence segments by the rules SB3 to SB11 of UAX #29, as character ranges that cover the text."""
    out, start = [], 0
    for m in _END.finditer(text):
        end = m.end()
        if end == len(text):
            break
        if not _SEPARATOR.match(text, end - 1):
            term = m[1]
            if _FULL_STOP.match(term):
                if _DIRECT.match(m[0]) and (_NUMERIC.match(text, end) or _UPPER.match(text, end) and _after_letter(text, m.start())):
                    continue
                if _LOWER_FIRST.match(text, end):
                    continue
            if _GOES_ON.match(text, end):
                continue
        out.append((start, end))
        start = end
    if start < len(text):
        out.append((start, len(text)))
    return out


def sentence_ranges(text: str) -> list[tuple[int, int]]:
    """Sentences: segments joined over abbreviations, trimmed, if they hold a letter or numeral."""
    out, start = [], None
    found = segments(text)
    for k, (a, b) in enumerate(found):
        start = a if start is None else start
        if _LEADING.sub("", _last_token(text, start, b)) in ABBREVIATIONS and k + 1 < len(found):
            continue
        s = text[start:b]
        head = len(s) - len(s.lstrip(_WHITE))
        s = s.strip(_WHITE)
        if _WORDLIKE.search(s):
            out.append((start + head, start + head + len(s)))
        start = None
    return out


@dataclass
class Block:
    """Joined spans: the text, and where each span begins in it and in the source (characters)."""

    text: str
    pieces: list[tuple[int, int]]

    def source(self, at: int) -> int:
        block, source = self.pieces[bisect_right(self.pieces, (at, 1 << 62)) - 1]
        return source + at - block


def join(source: str, spans: list[tuple[int, int, bool]]) -> Block:
    text, pieces = "", []
    for a, b, joins in spans:
        if pieces and not joins:
            text += " "
        pieces.append((len(text), a))
        text += source[a:b].replace("\n", " ").replace("\r", " ")
    return Block(text, pieces)


def plain_blocks(source: str) -> list[list[tuple[int, int, bool]]]:
    """Runs of lines that aren't blank, each one span without its last line break."""
    out: list[list[tuple[int, int, bool]]] = []
    start = end = None
    at = 0
    for line in source.split("\n"):
        bare = line.removesuffix("\r")
        if bare.strip(_WHITE):
            start = at if start is None else start
            end = at + len(bare)
        elif start is not None:
            out.append([(start, end, False)])
            start = None
        at += len(line) + 1
    if start is not None:
        out.append([(start, end, False)])
    return out


class Positions:
    """Character offsets as bytes, and as lines (ended by `\\n` only) with columns in characters, both from 1."""

    def __init__(self, source: str):
        self.source = source
        self.starts = [0]
        at = source.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = source.find("\n", at + 1)
        self.ascii = source.isascii()
        self.bytes = [0]
        if not self.ascii:
            total = 0
            for a, b in zip(self.starts, [*self.starts[1:], len(source)], strict=True):
                total += len(source[a:b].encode())
                self.bytes.append(total)

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        k = bisect_right(self.starts, at) - 1
        return self.bytes[k] + len(self.source[self.starts[k] : at].encode())

    def line(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.starts, at) - 1
        return k + 1, at - self.starts[k] + 1


def position(source: str, offset: int) -> tuple[int, int]:
    """Line and column of a byte offset; raises beyond the end and inside a character."""
    data = source.encode()
    if not 0 <= offset <= len(data):
        raise IndexError(f"byte {offset} is out of bounds")
    try:
        return Positions(source).line(len(data[:offset].decode()))
    except UnicodeDecodeError:
        raise ValueError(f"byte {offset} is inside a character") from None


def segment(source: str, format: str) -> dict:
    """The document's spans and blocks with their sentences, offsets in bytes."""
    spans = markdown.blocks(source) if format == "markdown" else plain_blocks(source)
    at = Positions(source)
    blocks = []
    for own in spans:
        b = join(source, own)
        sentences = []
        for x, y in sentence_ranges(b.text):
            first, last = b.source(x), b.source(y - 1) + 1
            (line, column), (end_line, end_column) = at.line(first), at.line(last)
            sentences.append({"text": b.text[x:y], "block_start": len(b.text[:x].encode()), "start": at.byte(first), "end": at.byte(last), "line": line, "column": column, "end_line": end_line, "end_column": end_column})
        pieces = [{"block_start": len(b.text[:p].encode()), "source_start": at.byte(q)} for p, q in b.pieces]
        blocks.append({"text": b.text, "pieces": pieces, "spans": [{"text": source[x:y], "start": at.byte(x), "end": at.byte(y), "joins_previous": j} for x, y, j in own], "sentences": sentences})
    return {"prose_spans": sum(map(len, spans)) if format == "markdown" else 1, "blocks": blocks}
