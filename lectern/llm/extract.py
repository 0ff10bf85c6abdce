"""HTML extraction: text blocks are labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html as entities
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, table

_TAG = re.compile(
    r"""<(?:(/?)([A-Za-z][^\s/>]*)(?:((?:"[^"]*"|'[^']*'|[^"'>])*+)(?:>|\Z)|([^>]*+)(?:>|\Z))|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z))""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, or is never shown; without an end tag it goes on to the end of the page, as in browsers.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp template".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in _RAW}
#: Elements whose text is never read, though what follows them is where they aren't closed.
_HIDDEN = frozenset("head svg annotation annotation-xml".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_NOT_IN_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu ol p pre ruby s small span strong sub sup table tt u ul var".split())
_MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mspace semantics annotation annotation-xml".split()
_INLINE = frozenset([*"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split(), *_MATH])
_CLOSES = {  # a start tag ends open elements of these kinds, up to the nearest of the second kinds
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), (frozenset({"p"}), frozenset("table td th caption button".split()))),
    "li": (frozenset({"li", "p"}), frozenset("ul ol menu".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd", "p"}), frozenset({"dl"}))),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    **dict.fromkeys(("td", "th"), (frozenset({"td", "th", "p"}), frozenset({"table", "tr"}))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}), frozenset({"table"}))),
}
#: What an element says about the text in it.
_TAG_SIGNAL = {
    **{"article": 5.0, "main": 4.0, "nav": -7.0, "footer": -7.0, "aside": -6.0, "header": -4.5, "form": -6.0, "button": -7.0, "menu": -6.0, "dialog": -6.0, "fieldset": -5.0},
    **dict.fromkeys("select datalist object audio video canvas".split(), -7.0),
}
_GIVES_WAY = frozenset("form header fieldset select datalist object audio video canvas".split())
_GOOD = frozenset("article articlebody content entry story post posts main maincontent text body prose blog hentry".split())
_BAD = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login signin register search form share sharing social comment comments commentlist disqus reply replies respond discussion "
    "related recommended recommendations trending popular widget widgets pagination pager paging tags taglist copyright legal disclaimer skip toc byline meta postmeta".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus reply replies".split())
#: Words that say what kind of thing a name is for, but not what it is about.
_PLAIN = frozenset("area bar block box c card col column component container div fixed global grid group holder id inner item items js left link links list main mobile module new outer page panel primary region right row secondary section site sticky the top bottom view wrap wrapper".split())
#: Words that say a thing is absent or elsewhere, before and after its name.
_NOT, _STATE = frozenset("has have hide no not with without".split()), frozenset("allowed closed count disabled enabled off on open".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def named(name: str) -> float:
    """What one class or id says: -6 where it is made of words for boilerplate, -2.5 where such a word is one of others, 3 for content; 0 says nothing."""
    words = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
    told = {w for i, w in enumerate(words) if not (i and words[i - 1] in _NOT or i + 1 < len(words) and words[i + 1] in _STATE)}
    if name.lower() in _BAD | _GOOD:
        told.add(name.lower())
    if told & _COMMENTS:
        return -7.0
    if told & _BAD:
        return -6.0 if told <= _BAD | _GOOD | _PLAIN else -2.5
    return 3.0 if told & _GOOD else 0.0


class Element:
    """An element that isn't inline: what its tag and its names say, and how much prose is in it."""

    __slots__ = ("context", "depth", "head", "named", "parent", "prose", "role", "tag")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.prose, self.head, self.context = 0, tag in ("h1", "main"), 0.0
        said, self.role = [], 0.0
        for name, value in attributes_of(attributes):
            if name in ("class", "id"):
                said += [named(w) for w in value.split()]
            elif name == "role":
                self.role = -7.0 if value.lower() in _BAD_ROLES else 4.0 if value.lower() in ("main", "article") else 0.0
        self.named = min(said, default=0.0) or max(said, default=0.0)
        if self.named > -7 and tag in ("body", "html", "article", "main"):
            self.named = max(self.named, 0.0)

    def weigh(self, whole: int) -> None:
        """Sets `context`, how much likelier than not text in it is content, in units of a classifier's cost.

        Names, forms and headers are evidence that gives way where most of the page's prose is within: then they name a wrapper
        of it. A name for comments stands, however long they are, unless a headline is within too.
        """
        above = self.parent.context if self.parent else 0.0
        share = self.prose / whole if whole and self.prose >= 300 else 0.0
        given = max(0.0, min(1.0, (0.6 - share) / 0.3))
        tag = _TAG_SIGNAL.get(self.tag, 0.0)
        if self.tag in _GIVES_WAY:
            tag *= given
        bad = min(0.0, self.named)
        bad = (0.0 if self.head and share else bad) if bad == -7.0 else bad * given
        if self.tag == "header" and above > 0 and not bad and self.role >= 0:
            own = 1.0  # an article's own header holds its headline
        elif self.role:
            own = self.role
        else:
            own = min(tag, bad) if bad or tag < 0 else max(tag, self.named)
        self.context = own or above
        if self.tag == "noscript":
            self.context -= 6.0  # a notice, as a rule


def attributes_of(raw: str) -> list[tuple[str, str]]:
    return [(n.lower(), v.strip("\"'")) for n, v in _ATTRIBUTE.findall(raw)] if raw else []


def unseen(raw: str) -> bool:
    """Whether attributes hide their element."""
    return bool(raw) and any(n == "hidden" or n == "aria-hidden" and v.lower() == "true" or n == "style" and _UNSEEN.search(v) for n, v in attributes_of(raw))


class Block:
    __slots__ = ("element", "letters", "linked", "parts", "text")

    def __init__(self, element: Element):
        self.element = element
        self.parts: list[str] = []
        self.text, self.letters, self.linked = "", 0, 0

    @property
    def link_share(self) -> float:
        return min(1.0, self.linked / self.letters) if self.letters else 0.0


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order: runs between tags of block-level elements, with what encloses them.

    Reads any input: unclosed, misnested and cut-off markup as browsers without scripts do in the main, a lone `<` as text.
    """
    found: list[Block] = []
    now: Block | None = None
    root = Element("", "", None)
    elements = [root]
    # (tag, innermost element that isn't inline, in a link, not shown)
    stack: list[tuple[str, Element, bool, bool]] = [("", root, False, False)]
    at, n = 0, len(page)

    def say(raw: str, plain: bool = False) -> None:
        nonlocal now
        if stack[-1][3]:
            return
        if "&" in raw and not plain:
            raw = entities.unescape(raw)
        if now is None:
            if not raw or raw.isspace():
                return
            now = Block(stack[-1][1])
        now.parts.append(raw)
        if stack[-1][2]:
            now.linked += len(raw) - raw.count(" ")

    def end() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join("".join(now.parts).split())
            now.letters = len(now.text) - now.text.count(" ")
            found.append(now)
            now = None

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(s[0] == "p" for s in stack) or tag == "br":
                say(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if any(s[0] not in _INLINE for s in stack[k:]):
                        if tag in _INLINE:  # a stray end of an inline element doesn't end the blocks in it
                            break
                        end()
                    del stack[k:]
                    break
            continue
        attributes = m[3] if m[3] is not None else m[4] or ""
        if tag not in _IN_HEAD and (k := next((k for k, e in enumerate(stack) if e[0] == "head"), 0)):
            del stack[k:]  # an unclosed head ends here
        if tag in _NOT_IN_SVG and (k := next((k for k, e in enumerate(stack) if e[0] == "svg"), 0)) and stack[-1][0] != "foreignobject":
            del stack[k:]  # and so does a drawing
        if tag in _RAW and not attributes.endswith("/"):
            stop = _RAW_END[tag].search(page, at)
            if tag == "xmp":  # shown as it is written
                end()
                say(page[at : stop.start() if stop else n], plain=True)
                end()
            at = stop.end() if stop else n
            continue
        if tag not in _INLINE:
            end()
            if tag in _CLOSES:
                kinds, border = _CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in border:
                        break
                    if stack[k][0] in kinds:
                        # go on outwards: a list item may hold a paragraph that is open too
                        del stack[k:]
        elif tag == "br":
            say(" ")
        if tag in _VOID or attributes.endswith("/") and tag in _HIDDEN:
            continue
        _, element, link, dark = stack[-1]
        if tag not in _INLINE:
            element = Element(tag, attributes, element)
            elements.append(element)
        stack.append((tag, element, link or tag == "a", dark or tag in _HIDDEN or unseen(attributes)))
    end()
    for b in found:
        if b.text.count(" ") >= 7:
            b.element.prose += max(0, b.letters - b.linked)
    for e in reversed(elements[1:]):
        e.parent.prose += e.prose
        e.parent.head |= e.head
    for e in elements:
        e.weigh(root.prose)
    return found


def cost(b: Block) -> float:
    """Positive for content, negative for boilerplate: place, length, share of links and ends of sentences."""
    words = b.text.count(" ") + 1
    score = b.element.context - 1.0 + min(3.0, words / 12) - 4.0 * b.link_share
    if words > 4 and b.text[-1] in ".!?…\"”»":
        score += 0.7
    if b.element.tag in ("p", "blockquote", "pre", "h1"):
        score += 0.9
    return score


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree. Between blocks that follow each other these are, over a page, not many more than its elements."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut.

    terminal: a node's capacity from the source (positive) or to the sink (negative); edges: (a, b, capacity) both
    ways. Dinic's algorithm: shortest augmenting paths by levels, found without recursion.
    """
    n = len(terminal)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a, b, there, back):
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(terminal):
        if c > 0:
            arc(source, i, c, 0)
        elif c < 0:
            arc(i, sink, -c, 0)
    for a, b, c in edges:
        arc(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                nxt[a] += 1
                continue
            path.append(e)
            a = to[e]


def labelled(found: list[Block], adjacent: float = 2.5, sibling: float = 1.2) -> list[bool]:
    """Whether each block is content: terminal capacities from `cost`, smoothness edges between neighbours in the page, weaker
    the further apart they are in the tree, and between a block and the last one of its kind with its parent. Blocks of which
    one is of links and the other isn't hold each other by so much less."""
    edges = []
    last: dict[tuple[int, bool], int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            edges.append((i - 1, i, round(100 * adjacent * (1 - abs(a.link_share - b.link_share)) / (1 + distance(a.element, b.element)))))
        kind = id(b.element.parent or b.element), b.link_share > 0.5
        if kind in last:
            edges.append((last[kind], i, round(100 * sibling)))
        last[kind] = i
    return min_cut([round(100 * cost(b)) for b in found], edges)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, labelled(found), strict=True) if keep and b.text)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text, n_chars) for each row: content blocks, each on a line, in page order.

    Null and empty pages and pages without content give an empty text. Pages are read whole, as a browser without scripts
    shows them: text of `noscript` and `math` counts, hidden elements don't. Repeated rows are answered again; other columns
    are ignored.
    """

    def batch(cols):
        texts = [main_text(h) for h in cols["html"]]
        yield {"id": cols["id"], **{f"k{i}": cols[f"k{i}"] for i in range(len(keep))}, "text": texts, "n_chars": [len(t) for t in texts]}

    names = {c: df.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).alias("html"))
    schema = ", ".join([f"id {names[id_col]}", *[f"k{i} {names[c]}" for i, c in enumerate(keep)], "text string, n_chars bigint"])
    out = map_arrow(rows, batch, schema, text="html")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")


def extract_query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
