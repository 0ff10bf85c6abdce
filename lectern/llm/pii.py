"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

Numbers, addresses and names of mailboxes are permuted within their format (a keyed Feistel network with cycle
walking), listed given names within their gender and script, so different entities get different surrogates. Surnames and
other given names are spelt from keyed syllables and could collide; that, and surrogates that are someone's real entity,
is checked over the whole corpus, and such entities draw again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, cut, map_arrow, small, table

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Mary Anna Emma Laura Julia Sarah Maria Claire Sophie Marie Camille Lucie Heike Ingrid Ursula Petra Sabine Carmen Lucia Elena Isabel Alice Susan Linda Barbara Elizabeth Jennifer Patricia Jessica Karen Olivia Sophia Isabella Charlotte Amelia Emily Hannah Natalie Victoria Rachel Rebecca Katherine Margaret Aisha Fatima Priya Mei Yuki Ingeborg Giulia Francesca Chiara Beatriz Agnieszka Katarzyna Zofia Ayşe".split(),
    ("latin", "m"): "John James Robert Michael William David Thomas Peter Paul Mark George Steven Pierre Jean Louis Antoine Hans Klaus Jürgen Stefan Wolfgang José Juan Carlos Miguel Pablo Richard Charles Daniel Matthew Joseph Andrew Anthony Benjamin Samuel Alexander Christopher Nicholas Patrick Kevin Brian Edward Henry Oliver Liam Noah Ethan Lucas Wei Hiroshi Raj Mohammed Ahmed Omar Giovanni Marco Luca Andreas Lars Sven Piotr Mateusz Mehmet Luis Fernando Diego".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αναστασία".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Παναγιώτης".split(),
}
TITLES = "mr mrs ms miss dr prof sir madam herr frau monsieur madame mme mlle señor señora sr sra don doña".split()
KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "given", "surname")
_GIVEN = {n.lower(): (key, i) for key, names in GIVEN.items() for i, n in enumerate(names)}
#: Titles that tell a gender. The others don't.
_TITLE_OF = {**dict.fromkeys("mrs ms miss madam frau madame mme mlle señora sra doña".split(), "f"), **dict.fromkeys("mr sir herr monsieur señor sr don".split(), "m")}
_UPPER = "A-ZÀ-ÖØ-ÞŠŽŁŚА-ЯЁΑ-ΩΆΈΉΊΌΎΏ"
_LEAD = re.compile(rf"(?<!\w)[{_UPPER}][^\W\d_]*\.?(?=[  ][{_UPPER}])")
_NAME = re.compile(rf"[{_UPPER}](?:['’][{_UPPER}])?[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_MIDDLE = re.compile(rf"[{_UPPER}]\.[  ]")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_CARD = re.compile(r"(?<![\w.-])(?:(?:[3-6]\d{3}|2[2-7]\d{2})(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])")


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def luhn(digits: str) -> int:
    """Check digit that follows `digits`."""
    return -sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def is_card(number: str) -> bool:
    """Whether the number has a card's length and check digit; other numbers aren't personal."""
    d = "".join(c for c in number if c.isdigit())
    return 13 <= len(d) <= 19 and luhn(d[:-1]) == int(d[-1])


def phones(text: str, others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Phone numbers, each one number: it ends before an entity of `others` that follows, and has 15 digits at most (11 after +1 and +7)."""
    out: list[tuple[int, int, str]] = []
    at = 0
    while m := _PHONE.search(text, at):
        a, b = m.span()
        most = 11 if text[a] == "+" and text[a + 1] in "17" else 15
        later = [c for c, *_ in others if a < c < b]
        for end in sorted({*(a + g.end() for g in _RUN.finditer(m[0])), b}, reverse=True):
            n = sum(c.isdigit() for c in text[a:end])
            if 7 <= n <= most and end <= min(later, default=end) and _PHONE.fullmatch(text[a:end]):
                b = end
                break
        out.append((a, b, "phone"))
        at = b
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, not overlapping; a person's given name and surname are spans of their own."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _DIGITS.search(text):
        for kind, pattern in (("iban", _IBAN), ("ip", _IP), ("ssn", _SSN), ("card", _CARD)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if kind != "card" or is_card(m[0])]
        found += phones(text, [s for s in found if s[2] != "email"])
    end = -1
    for m in _LEAD.finditer(text):
        if m.start() < end:
            continue
        word = m[0].rstrip(".").lower()
        given = word in _GIVEN and not m[0].endswith(".")
        if not given and word not in TITLES:
            continue
        at = m.end() + 1
        if given:
            if k := _MIDDLE.match(text, at):
                at = k.end()
            parts = [(m.start(), m.end(), "given")]
        else:
            parts = []
            first = _NAME.match(text, at)
            if first and first[0].lower() not in TITLES and text[first.end() : first.end() + 1] in (" ", "\u00a0"):
                then = _MIDDLE.match(text, first.end() + 1)
                last = _NAME.match(text, then.end() if then else first.end() + 1)
                if last and len(last[0]) > 1 and last[0].isupper() == first[0].isupper():  # after a title, of two names the first is given, listed or not
                    parts, at = [(first.start(), first.end(), "given")], last.start()
        last = _NAME.match(text, at)
        if last and len(last[0]) > 1 and not (last[0].isupper() and text[last.end() : last.end() + 1] == "!"):
            found += [*parts, (last.start(), last.end(), "surname")]
            end = last.end()
    named = {form: k for a, b, k in found if k in ("given", "surname") for form in ((text[a:b], text[a:b].upper()) if b - a > 2 else (text[a:b],))}
    if named:  # the same people, later by one of their names alone
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(named, key=len, reverse=True)))})(?!\w)")
        found += [(m.start(), m.end(), named[m[0]]) for m in again.finditer(text)]
    order = {k: i for i, k in enumerate(("email", "iban", "ip", "ssn", "card", "phone", "given", "surname"))}
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0], -s[1], order[s[2]])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


_RUN = re.compile(r"\d+")
_DIGITS = re.compile(r"\d[\d .()-]{5}")


def keyed(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of range(size): eight Feistel rounds over the next even number of bits, walked until in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(8):
            left, right = right, left ^ (keyed(key, tweak, size, r, right) & mask)
        x = left << half | right
        if x < size:
            return x


_SETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_PLACE = {c: (s, i) for s in _SETS for i, c in enumerate(s)}


def in_format(key: bytes, tweak: str, s: str, fixed: Iterable[int] = ()) -> str:
    """`s` with its ASCII letters and digits permuted together, each within its class; other characters, and those at `fixed`, stay."""
    fixed = set(fixed)
    at = [i for i, c in enumerate(s) if c in _PLACE and i not in fixed]
    x = size = 0
    size = 1
    for i in at:
        own, k = _PLACE[s[i]]
        x, size = x * len(own) + k, size * len(own)
    form = "".join(c if i in fixed or c not in _PLACE else str(_SETS.index(_PLACE[c][0])) for i, c in enumerate(s))
    x = permute(key, f"{tweak}|{form}", x, size)
    out = list(s)
    for i in reversed(at):
        own = _PLACE[s[i]][0]
        x, k = divmod(x, len(own))
        out[i] = own[k]
    return "".join(out)


_SYLLABLES = {
    "latin": ([a + b for a in ("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "br", "gr") for b in "aeiou"], ("n", "r", "s", "l", "ck", "nd", "rt", "m")),
    "cyrillic": ([a + b for a in "бвгдзклмнпрст" for b in "аеиоу"], ("н", "в", "р", "к", "с")),
    "greek": ([a + b for a in "βγδκλμνπρστ" for b in "αεηο"], ("ς", "ν", "δης", "κης")),
}


#: Endings of Russian surnames, and what a woman's has in their place.
_FAMILY = re.compile(r"(ов|ев|ёв|ин|ын|ск|цк)(а|ая|ий|ой)?$")


def family(name: str) -> tuple[str, str]:
    """(family, ending) of a surname in small letters: a Russian one as a man's, and the ending that it has here."""
    if script_of(name) == "cyrillic" and len(name) > 4 and (m := _FAMILY.search(name)):
        if m[1] in ("ск", "цк"):
            return (name[: m.end(1)] + "ий", name[m.start(1) :]) if m[2] in ("ий", "ой", "ая") else (name, "")
        if m[2] in (None, "а"):
            return name[: m.end(1)], name[m.start(1) :]
    return name, ""


def spelt(key: bytes, kind: str, attempt: int, name: str) -> tuple[str, int]:
    """Keyed syllables in the script of the name, and what is left to draw from."""
    own, _ = _SYLLABLES[script_of(name)]
    x = keyed(key, kind, attempt, name)
    out = ""
    for _ in range(4 + attempt // 4):
        x, k = divmod(x, len(own))
        out += own[k]
    return out, x


def surname(key: bytes, attempt: int, name: str) -> str:
    stem, ending = family(name.lower())
    out, x = spelt(key, "surname", attempt, stem)
    ends = _SYLLABLES[script_of(name)][1]
    return out[:-1] + ending if ending[:1] in tuple("оеёиы") else out + (ending or ends[x % len(ends)])


def other_given(key: bytes, attempt: int, name: str) -> str:
    """A given name that no list has: spelt anew; one that ends in a woman's vowel keeps it, any other ends in a consonant."""
    out, x = spelt(key, "given", attempt, name.lower())
    last = name[-1].lower()
    ends = _SYLLABLES[script_of(name)][1]
    return out[:-1] + last if last in "aаяαη" else out + ends[x % len(ends)]


@lru_cache(64)
def _cycle(key: bytes, kind: tuple[str, str]) -> dict[int, int]:
    """Each name of a pool to the next in keyed order: a permutation without a fixed point."""
    order = sorted(range(len(GIVEN[kind])), key=lambda i: keyed(key, *kind, i))
    return dict(zip(order, order[1:] + order[:1], strict=True))


def like_case(model: str, s: str) -> str:
    return s.upper() if model.isupper() and len(model) > 1 else s if model.islower() else s[:1].upper() + s[1:]


def canonical(kind: str, value: str) -> str:
    """Spellings of one entity are one: letter case of mail addresses and names, and the punctuation of numbers."""
    if kind == "surname":
        return family(value.lower())[0]
    if kind in ("email", "given"):
        return value.lower()
    if kind == "phone":
        digits, n = re.sub(r"[^0-9]", "", value), country(value)
        return f"+{digits[:n]} {digits[n:]}" if n else digits
    return re.sub(r"[^A-Z0-9.]", "", value)


def country(phone: str) -> int:
    """Digits of the country code, 0 without one; where it isn't set off, one or two are taken for it."""
    if not phone.startswith("+"):
        return 0
    n = len(re.match(r"\+(\d*)", phone)[1])
    return n if n <= 3 else 1 if phone[1] in "17" else 2


def _network(x: int) -> int:
    """Kind of an IPv4 address: private and local ones stay what they are."""
    a, b = x >> 24, x >> 16 & 255
    return 1 if a == 10 else 2 if a == 127 else 3 if (a, b) == (192, 168) else 4 if a == 172 and 16 <= b < 32 else 5 if a == 0 or a >= 224 else 0


#: Bits of an address within each private or local range.
_HOSTS = {1: 24, 2: 24, 3: 16, 4: 20}


def refill(model: str, digits: str) -> str:
    """`model` with its letters and digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in model)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of an entity as written. It depends on the entity's canonical form alone, but for case and punctuation."""
    tweak = f"{kind}|{attempt}"
    own = canonical(kind, value)
    if kind == "given":
        if own not in _GIVEN:
            return like_case(value, other_given(key, attempt, value))
        place, i = _GIVEN[own]
        return like_case(value, GIVEN[place][_cycle(key, place)[i]])
    if kind == "surname":
        return like_case(value, surname(key, attempt, value))
    if kind == "email":
        local, _, domain = own.partition("@")
        stem, _, top = domain.rpartition(".")
        out = f"{in_format(key, tweak, local)}@{in_format(key, f'domain|{attempt}', stem)}.{top}"
        return out.upper() if value.isupper() else out
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, own.split("."))), "big")
        kind_of = _network(x)
        if kind_of in _HOSTS:  # a private range is permuted in itself
            low = (1 << _HOSTS[kind_of]) - 1
            y = x & ~low | permute(key, f"{tweak}|{kind_of}", x & low, low + 1)
        else:
            y = permute(key, tweak, x, 1 << 32)
            while _network(y) != kind_of:
                y = permute(key, tweak, y, 1 << 32)
        return ".".join(map(str, y.to_bytes(4, "big")))
    if kind == "card":
        body = in_format(key, tweak, own[:-1], [0])
        return refill(value, body + str(luhn(body)))
    if kind == "iban":
        body = in_format(key, tweak, own[4:])
        rest = "".join(str(int(c, 36)) for c in body + own[:2] + "00")
        return refill(value, f"{own[:2]}{98 - int(rest) % 97:02d}{body}")
    if kind == "phone":
        n = country(own)
        digits = re.sub(r"[^0-9]", "", own)
        return refill(value, in_format(key, f"{tweak}|{n}", digits, range(n)))
    area = lambda s: s[:3] in ("000", "666") or s[0] == "9"
    out = in_format(key, tweak, own)
    while area(out) != area(own):
        out = in_format(key, tweak, out)
    return refill(value, out)


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities' (start, end, kind) in it."""
    out, at, size, where = [], 0, 0, []
    for a, b, kind in spans(text):
        s = surrogate(key, kind, text[a:b], attempts.get((kind, canonical(kind, text[a:b])), 0))
        out += [text[at:a], s]
        size += a - at
        where.append((size, size + len(s), kind))
        size += len(s)
        at = b
    return "".join([*out, text[at:]]), where


def entities(df: DataFrame, text_col: str) -> DataFrame:
    """(of, kind, value) of the entities in each row's text, once each, in canonical form; `of` is a hash of the text."""

    def batch(cols):
        out = {"of": [], "kind": [], "value": []}
        for i, t in zip(cols["of"], cols["text"], strict=True):
            for kind, value in {(k, canonical(k, t[a:b])) for a, b, k in spans(t or "")}:
                for name, x in (("of", i), ("kind", kind), ("value", value)):
                    out[name].append(x)
        yield out

    return map_arrow(df.select(F.xxhash64(text_col).alias("of"), F.col(text_col).alias("text")), batch, "of bigint, kind string, value string", text="text")


def drawn(df: DataFrame, key: bytes, attempt: int) -> DataFrame:
    """(kind, value, drawn) with each entity's surrogate, in canonical form, at an attempt."""

    def batch(cols):
        yield {"kind": cols["kind"], "value": cols["value"], "drawn": [canonical(k, surrogate(key, k, v, attempt)) for k, v in zip(cols["kind"], cols["value"], strict=True)]}

    return map_arrow(df.select("kind", "value"), batch, "kind string, value string, drawn string")


def redrawn(found: DataFrame, key: bytes, most: int = 24) -> DataFrame | None:
    """(kind, value, attempt) of the entities whose first surrogate isn't theirs alone; None if there is none.

    `found` has the distinct entities of the corpus. A surrogate must be no other entity's surrogate and no entity of
    the corpus. Listed given names are left out: their pools are finite and permuted. Where a kind still collides after
    `most` draws (a corpus may name every address of a private range), all its entities keep their first draw: a
    permutation, so they stay distinct, but a surrogate may then be someone else's real entity. Names never get there, for
    they grow.
    """
    listed = F.col("value").isin(*_GIVEN) if len(_GIVEN) else F.lit(False)
    held = cut(drawn(found.where((F.col("kind") != "given") | ~listed), key, 0).withColumn("attempt", F.lit(0)))
    for attempt in range(1, most + 1):
        twice = held.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = held.join(twice, ["kind", "drawn"]).where(F.struct("attempt", "value") != F.col("first")).select("kind", "value")
        real = held.join(held.select("kind", F.col("value").alias("drawn")), ["kind", "drawn"], "left_semi").select("kind", "value")
        flagged = cut(again.union(real).distinct())
        if flagged.isEmpty():
            return None if attempt == 1 else cut(held.where("attempt > 0").select("kind", "value", "attempt"))
        if attempt < most:
            held = cut(held.join(flagged, ["kind", "value"], "left_anti").union(drawn(flagged, key, attempt).withColumn("attempt", F.lit(attempt))))
    dense = [r.kind for r in flagged.select("kind").distinct().collect()]  # of KINDS
    return cut(held.where((F.col("attempt") > 0) & ~F.col("kind").isin(dense)).select("kind", "value", "attempt"))


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, spans array<struct<kind, start, end>>) for each row, and the columns named in `carry`: the text with surrogates and where these are.

    An entity has the same surrogate in every document, and different entities have different ones. Entities that
    drew again are broadcast if they are `broadcast_rows` at most, else they come to their texts by a join on a hash of
    the text; both ways give the same result. A null text stays null, and texts without entities stay as they are; texts
    are read whole; repeated rows and rows without an id are answered like any other; an empty table gives no rows; other
    columns are ignored.
    """
    mentions = cut(entities(df, text_col).distinct())
    moved = redrawn(mentions.select("kind", "value").distinct(), key)
    held = tuple(f"carried_{i}" for i in range(len(carry)))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(h) for c, h in zip(carry, held, strict=True)])
    kind = df.schema[id_col].dataType.simpleString()
    table_: dict[tuple[str, str], int] = {}
    if moved is None or small(moved, broadcast_rows):
        table_ = {(r.kind, r.value): r.attempt for r in moved.collect()} if moved is not None else {}
        rows = rows.withColumn("moved", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        own = mentions.join(moved, ["kind", "value"]).groupBy("of").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("moved"))
        rows = rows.withColumn("of", F.xxhash64("text")).join(own, "of", "left").drop("of")
    sent = df.sparkSession.sparkContext.broadcast(table_)

    def batch(cols):
        texts, where = [], []
        for t, moved in zip(cols["text"], cols["moved"], strict=True):
            own = sent.value if not moved else {(m["kind"], m["value"]): m["attempt"] for m in moved}
            new, at = (None, []) if t is None else replaced(t, key, own)
            texts.append(new)
            where.append([{"kind": k, "start": a, "end": b} for a, b, k in at])
        yield {"id": cols["id"], "text": texts, "spans": where}

    out = map_arrow(rows, batch, f"id {kind}, text string, spans array<struct<kind: string, start: bigint, end: bigint>>", text="text", carry=held)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], "spans")


#: Key of the query. A user passes their own.
QUERY_KEY = b"a key for tests"


def pii_query(spark, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
    count = lambda *kinds: F.size(F.filter("spans", lambda x: x.kind.isin(*kinds))).cast("bigint")
    return out.select("doc_id", "text", *[count(k).alias(f"n_{k}") for k in KINDS if k not in ("given", "surname")], count("surname").alias("n_person"), F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",").alias("spans"))
