"""Prose of Markdown: the text spans of paragraphs and list items, with their places in the source.

CommonMark with tables, math and front matter. A block is a list of spans (start, end, joins): half-open character
ranges of the source, and whether only the marks of emphasis or links, or the backslash of an escape, lie between a
span and the one before. Headings, code, HTML, tables, images, math, autolinks and character references give no span.

Blocks are found first, line by line (containers by their prefixes, then leaves); then the text of each paragraph is
read for inline marks, once the link definitions of the whole document are known.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

_BULLET = re.compile(r"([-+*])(?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ATX = re.compile(r"#{1,6}(?:[ \t]|$)")
_SETEXT = re.compile(r"(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r"(`{3,})(?=[^`]*$)|(~{3,})")
_CELL = re.compile(r":?-+:?")
_HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_OPEN = r"""<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>"""
_CLOSE = r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML_STARTS = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{_HTML_NAMES.replace(' ', '|')})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{_OPEN}|{_CLOSE})\s*$"), None),  # can't interrupt a paragraph
]
_INLINE_HTML = re.compile(rf"{_OPEN}|{_CLOSE}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9.+-]{1,31}:[^\s<>]*>|<[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*>")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){0,999})\]", re.S)
_DESTINATION = re.compile(r"<(?:[^<>\\\n]|\\.)*>|(?!<)(?:[^\s\\()\x00-\x1f]|\\.|\((?:[^\s\\()]|\\.|\((?:[^\s\\()]|\\.)*\))*\))+", re.S)
_TITLE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)", re.S)


@dataclass
class Node:
    kind: str  # document, quote, list, item, paragraph, code, html, table
    column: int = 0  # item: columns its content is indented by
    mark: str = ""
    lines: list[tuple[int, int]] = field(default_factory=list)  # source ranges of a paragraph's lines
    end: object = None  # fence or the pattern that ends an HTML block
    empty: bool = False  # item without a line of content yet


class Line:
    """A source line being consumed from the left, with tabs as columns to multiples of four."""

    def __init__(self, source: str, start: int, end: int):
        self.s, self.at, self.end = source, start, end
        self.column = 0
        self.part = 0  # columns of a tab that are consumed already

    def indent(self) -> int:
        col, i = self.column, self.at
        while i < self.end and self.s[i] in " \t":
            if self.s[i] == " ":
                col += 1
            else:
                col += 4 - self.part if self.part and i == self.at else 4 - col % 4
            i += 1
        return col - self.column

    def skip(self, columns: int) -> None:
        while columns > 0 and self.at < self.end and self.s[self.at] in " \t":
            if self.s[self.at] == " ":
                self.at += 1
                self.column += 1
                columns -= 1
            else:
                width = (4 - self.part) if self.part else 4 - self.column % 4
                take = min(width, columns)
                self.column += take
                columns -= take
                if take == width:
                    self.at += 1
                    self.part = 0
                else:
                    self.part = 4 - (width - take)

    def skip_all(self) -> None:
        self.skip(self.indent())

    def rest(self) -> str:
        return self.s[self.at : self.end]

    def blank(self) -> bool:
        return not self.rest().strip(" \t")


def _lines(source: str) -> list[tuple[int, int]]:
    out, start = [], 0
    for m in re.finditer(r"\r\n|\n|\r", source):
        out.append((start, m.start()))
        start = m.end()
    if start < len(source):
        out.append((start, len(source)))
    return out


def _front_matter(source: str, lines: list[tuple[int, int]]) -> int:
    """Lines that front matter takes at the beginning."""
    if len(lines) < 2:
        return 0
    first = source[slice(*lines[0])].rstrip(" \t")
    if first not in ("---", "+++") or not source[slice(*lines[1])].strip():
        return 0
    ends = ("---", "...") if first == "---" else ("+++",)
    for k in range(1, len(lines)):
        if source[slice(*lines[k])].rstrip(" \t") in ends:
            return k + 1
    return 0


def _cells(row: str) -> int:
    row = row.strip()
    row = row.removeprefix("|")
    row = re.sub(r"(?<!\\)\|$", "", row)
    return len(re.findall(r"(?<!\\)\|", row)) + 1


def _delimiter_row(row: str) -> int:
    """Columns of a table's delimiter row, 0 if it is none."""
    row = row.strip()
    if "-" not in row or not re.fullmatch(r"[|:\- \t]+", row):
        return 0
    cells = [c.strip() for c in row.removeprefix("|").removesuffix("|").split("|")]
    return len(cells) if all(_CELL.fullmatch(c) for c in cells) else 0


def paragraphs(source: str) -> tuple[list[list[tuple[int, int]]], dict[str, bool]]:
    """Line ranges of each paragraph that is prose, in order, and the labels of link definitions."""
    lines = _lines(source)
    open_: list[Node] = [Node("document")]
    leaf: Node | None = None
    found: list[list[tuple[int, int]]] = []
    labels: dict[str, bool] = {}

    def close() -> None:
        nonlocal leaf
        if leaf is not None and leaf.kind == "paragraph":
            rest = _definitions(source, leaf.lines, labels)
            if rest:
                found.append(rest)
        leaf = None

    k = _front_matter(source, lines)
    while k < len(lines):
        line = Line(source, *lines[k])
        k += 1
        depth = 1
        while depth < len(open_):
            node = open_[depth]
            if node.kind == "quote":
                if line.indent() <= 3 and line.rest().lstrip(" \t").startswith(">"):
                    line.skip_all()
                    line.at += 1
                    line.column += 1
                    line.skip(min(1, line.indent()))
                else:
                    break
            elif node.kind == "item":
                if line.blank():
                    if node.empty:
                        break
                elif line.indent() >= node.column:
                    line.skip(node.column)
                else:
                    break
                if not line.blank():
                    node.empty = False
            depth += 1
        matched = depth == len(open_)
        if leaf is not None and matched and leaf.kind in ("code", "html"):
            if leaf.kind == "code" and leaf.end is None:  # indented
                if line.blank() or line.indent() >= 4:
                    continue
                close()
            elif leaf.kind == "code":
                rest = line.rest().strip(" \t")
                if line.indent() <= 3 and rest and not rest.strip(leaf.end[0]) and len(rest) >= len(leaf.end):
                    leaf = None
                continue
            else:
                if leaf.end is None:
                    if line.blank():
                        leaf = None
                    continue
                if leaf.end.search(line.rest()):
                    leaf = None
                continue
        elif leaf is not None and not matched and leaf.kind != "paragraph":
            close()
        # new containers and leaves
        lazy = leaf is not None and leaf.kind == "paragraph"
        fresh = False
        while True:
            indent = line.indent()
            rest = line.rest().lstrip(" \t")
            in_paragraph = lazy and not fresh and matched
            if indent >= 4 or not rest:
                break
            if rest[0] == ">":
                close()
                del open_[depth:]
                line.skip_all()
                line.at += 1
                line.column += 1
                line.skip(min(1, line.indent()))
                open_.append(Node("quote"))
            elif _RULE.match(rest) and not (in_paragraph and _SETEXT.match(rest)):
                break
            elif (m := _BULLET.match(rest) or _ORDERED.match(rest)) is not None:
                content = rest[m.end() :].strip(" \t")
                if in_paragraph and (not content or m.re is _ORDERED and m[1] != "1"):
                    break
                close()
                del open_[depth:]
                line.skip_all()
                line.at += m.end()
                line.column += m.end()
                spaces = line.indent()
                take = 1 if not content or spaces > 4 else spaces
                open_.append(Node("item", indent + m.end() + take, m[0][-1], empty=not content))
                line.skip(min(take, spaces))
            else:
                break
            depth = len(open_)
            matched, fresh, lazy = True, True, False
        rest = line.rest().lstrip(" \t")
        indent = line.indent()
        if not rest:
            close()
            if not matched:
                del open_[depth:]
            continue
        if indent < 4:
            starts = next((i for i, (p, _) in enumerate(_HTML_STARTS) if p.match(rest)), None)
            if starts == 6 and leaf is not None and leaf.kind == "paragraph":
                starts = None
            fence = _FENCE.match(rest)
            if _ATX.match(rest) or fence or starts is not None:
                close()
                del open_[depth:]
                if fence:
                    leaf = Node("code", end=fence[0])
                elif starts is not None:
                    ends = _HTML_STARTS[starts][1]
                    leaf = Node("html", end=ends)
                    if ends is not None and ends.search(rest[2 if starts == 1 else 0 :]):
                        leaf = None
                continue
            if leaf is not None and leaf.kind == "paragraph" and matched and _SETEXT.match(rest):
                remaining = _definitions(source, leaf.lines, labels)
                leaf = None
                if remaining:
                    continue
            if _RULE.match(rest):
                close()
                del open_[depth:]
                continue
        if leaf is not None and leaf.kind == "paragraph":  # goes on, lazily too
            at = line.at + len(line.rest()) - len(rest)
            leaf.lines.append((at, line.end))
            if len(leaf.lines) == 2 and matched:
                head = source[slice(*leaf.lines[0])]
                n = _delimiter_row(rest)
                if n and "|" in re.sub(r"\\.", "", head) and _cells(head) == n:
                    leaf = Node("table")
            continue
        if leaf is not None and leaf.kind == "table":
            continue
        del open_[depth:]
        if indent >= 4:
            close()
            leaf = Node("code")
            continue
        at = line.at + len(line.rest()) - len(rest)
        leaf = Node("paragraph", lines=[(at, line.end)])
    close()
    return found, labels


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _definitions(source: str, lines: list[tuple[int, int]], labels: dict[str, bool]) -> list[tuple[int, int]]:
    """What is left of a paragraph's lines when the link definitions at its beginning are taken off."""
    while lines and source[lines[0][0]] == "[":
        text = "\n".join(source[a:b] for a, b in lines)
        m = _LABEL.match(text)
        if not m or not m[1].strip() or text[m.end() : m.end() + 1] != ":":
            return lines
        i = m.end() + 1
        i += len(re.match(r"[ \t]*\n?[ \t]*", text[i:])[0])
        d = _DESTINATION.match(text, i)
        if not d:
            return lines
        i = d.end()
        end = None
        t = re.match(r"[ \t]*\n?[ \t]*", text[i:])
        if t[0] and (title := _TITLE.match(text, i + t.end())) and (stop := re.match(r"[ \t]*(?:\n|$)", text[title.end() :])):
            end = title.end() + stop.end()
        elif stop := re.match(r"[ \t]*(?:\n|$)", text[i:]):
            end = i + stop.end()
        if end is None:
            return lines
        labels.setdefault(_label(m[1]), True)
        if end == len(text):
            return []
        lines = lines[text[:end].count("\n") :]
    return lines


@dataclass
class _Mark:
    """A delimiter run or bracket in the inline stack."""

    at: int
    n: int
    char: str
    opens: bool
    closes: bool
    size: int
    active: bool = True


def _is_space(c: str) -> bool:
    return c == "" or c.isspace()


def _is_punct(c: str) -> bool:
    return c != "" and (c in _PUNCT or unicodedata.category(c)[0] in "PS")


#: What a character of the inline text is.
_TEXT, _MARKUP, _BREAK = 0, 1, 2


def spans_of(source: str, lines: list[tuple[int, int]], labels: dict[str, bool]) -> list[tuple[int, int, bool]]:
    """Spans of a paragraph. Every character gets a kind: text, the marks of emphasis, links and escapes (which join
    what they part), or anything else (which doesn't)."""
    text, where = "", []
    for i, (a, b) in enumerate(lines):
        body = source[a:b]
        last = i == len(lines) - 1
        keep = body.rstrip(" \t")
        text += keep + ("" if last else "\n")
        where += range(a, a + len(keep) + (0 if last else 1))
    kind = [_TEXT] * len(text)
    runs: list[_Mark] = []
    brackets: list[tuple[int, int, bool]] = []  # place, place in `runs`, is an image
    inactive: set[int] = set()

    def mark(a: int, b: int, k: int) -> None:
        kind[a:b] = [k] * (b - a)

    def emphasis(bottom: int) -> None:
        """Pairs the delimiter runs above `bottom`, as the standard's procedure does; what stays is text."""
        closer = bottom
        floor: dict[tuple, int] = {}
        while closer < len(runs):
            c = runs[closer]
            if not c.closes or c.n == 0:
                closer += 1
                continue
            opener = closer - 1
            key = (c.char, c.opens, c.size % 3)
            low = max(bottom, floor.get(key, bottom))
            while opener >= low:
                o = runs[opener]
                odd = (o.closes or c.opens) and (o.size + c.size) % 3 == 0 and not (o.size % 3 == 0 and c.size % 3 == 0)
                if o.n and o.char == c.char and o.opens and not odd:
                    break
                opener -= 1
            if opener < low:
                floor[key] = closer
                if not c.opens:
                    runs.pop(closer)
                else:
                    closer += 1
                continue
            o = runs[opener]
            use = 2 if o.n >= 2 and c.n >= 2 else 1
            mark(o.at + o.n - use, o.at + o.n, _MARKUP)
            mark(c.at, c.at + use, _MARKUP)
            o.n -= use
            c.at += use
            c.n -= use
            del runs[opener + 1 : closer]
            closer = opener + 1
            if o.n == 0:
                runs.pop(opener)
                closer -= 1
            if c.n == 0:
                runs.pop(closer)
        del runs[bottom:]

    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            if i + 1 < n and text[i + 1] in _PUNCT:
                kind[i] = _MARKUP
                i += 2
                continue
            if i + 1 < n and text[i + 1] == "\n":
                kind[i] = _BREAK
            i += 1
        elif c == "\n":
            kind[i] = _BREAK
            i += 1
        elif c == "`":
            size = len(re.match("`+", text[i:])[0])
            for m in re.compile("`+").finditer(text, i + size):
                if len(m[0]) == size:
                    mark(i, m.end(), _BREAK)
                    i = m.end()
                    break
            else:
                i += size
        elif c == "$":
            size = 2 if text[i : i + 2] == "$$" else 1
            end = -1
            if size == 2:
                end = text.find("$$", i + 2)
            elif i + 1 < n and not text[i + 1].isspace():
                at = i + 1
                while (at := text.find("$", at)) >= 0:
                    if text[at - 1] != "\\" and not text[at - 1].isspace() and text[at + 1 : at + 2] != "$":
                        end = at
                        break
                    at += 1
            if end > i:
                mark(i, end + size, _BREAK)
                i = end + size
            else:
                i += size
        elif c == "<":
            m = _AUTOLINK.match(text, i) or _INLINE_HTML.match(text, i)
            if m:
                mark(i, m.end(), _BREAK)
                i = m.end()
            else:
                i += 1
        elif c == "&":
            m = _ENTITY.match(text, i)
            if m and html.unescape(m[0]) != m[0]:
                mark(i, m.end(), _BREAK)
                i = m.end()
            else:
                i += 1
        elif c in "*_":
            size = len(re.match(re.escape(c) + "+", text[i:])[0])
            before, after = text[i - 1] if i else "", text[i + size] if i + size < n else ""
            left = not _is_space(after) and (not _is_punct(after) or _is_space(before) or _is_punct(before))
            right = not _is_space(before) and (not _is_punct(before) or _is_space(after) or _is_punct(after))
            opens = left and (c == "*" or not right or _is_punct(before))
            closes = right and (c == "*" or not left or _is_punct(after))
            runs.append(_Mark(i, size, c, opens, closes, size))
            i += size
        elif c == "[" or c == "!" and text[i + 1 : i + 2] == "[":
            image = c == "!"
            brackets.append((i, len(runs), image))
            i += 1 + image
        elif c == "]":
            if not brackets:
                i += 1
                continue
            at, bottom, image = brackets.pop()
            inner = at + 1 + image
            end = _target(text, i, inner, labels) if at not in inactive or image else None
            if end is None:
                i += 1
                continue
            emphasis(bottom)
            if image:
                mark(at, end, _BREAK)
            else:
                kind[at] = _MARKUP
                mark(i, end, _MARKUP)
                inactive.update(b[0] for b in brackets if not b[2])
            i = end
        else:
            i += 1
    emphasis(0)
    out: list[tuple[int, int, bool]] = []
    joins = False
    i = 0
    while i < n:
        if kind[i] == _TEXT:
            j = i
            while j < n and kind[j] == _TEXT:
                j += 1
            out.append((where[i], where[j - 1] + 1, joins and bool(out)))
            joins = True
            i = j
        else:
            if kind[i] == _BREAK:
                joins = False
            i += 1
    return out


def _target(text: str, close: int, inner: int, labels: dict[str, bool]) -> int | None:
    """Where the link ends whose bracket closes at `close`: inline, full, collapsed or shortcut."""
    i = close + 1
    if text[i : i + 1] == "(":
        j = i + 1 + len(re.match(r"[ \t\n]*", text[i + 1 :])[0])
        d = _DESTINATION.match(text, j)
        e = d.end() if d else j
        s = re.match(r"[ \t\n]*", text[e:]).end() + e
        if s > e and d and (t := _TITLE.match(text, s)):
            s = t.end() + re.match(r"[ \t\n]*", text[t.end() :]).end()
        if text[s : s + 1] == ")":
            return s + 1
    m = _LABEL.match(text, i)
    if m and m[1].strip():
        return m.end() if _label(m[1]) in labels else None
    own = text[inner:close]
    if own.strip() and not re.search(r"(?<!\\)\[", own) and _label(own) in labels:
        return m.end() if m else i
    return None


def blocks(source: str) -> list[list[tuple[int, int, bool]]]:
    """The blocks of a Markdown document that have a span."""
    found, labels = paragraphs(source)
    return [s for s in (spans_of(source, lines, labels) for lines in found) if s]
