"""Secret scans: three fixed patterns, and sliding-window Shannon entropy over other candidate strings."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so this equals runs of any length kept from 16 on
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Entropy in bits that a window must reach, by the narrowest class that holds the candidate. Digits alone are no secret.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: Harmless strings of high entropy. A candidate that one of the first matches whole is suppressed; of one that holds a
#: match of PLACEHOLDER, the windows that overlap it are.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9=_/+-]+",  # rules and numbers
    r"(?:[A-Za-z]+[0-9]{0,4}[/_=-]+)+[A-Za-z]*[0-9]{0,4}",  # paths and identifiers made of words
)
PLACEHOLDER = re.compile("EXAMPLE|example|0123456789|abcdefghij")
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+")), ("alnum", re.compile(r"[A-Za-z0-9]+")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def hot_windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Maximal unions of the windows of `width` characters whose Shannon entropy is `least` bits or more.

    H = log2(w) - sum(c log2 c) / w; moving by one character changes two counts, so the sum is kept, not recomputed.
    """
    n = len(s)
    if n < width:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    out: list[tuple[int, int]] = []
    full = math.log2(width)
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= width:
            old = s[i - width]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= width - 1 and full - total / width >= least - 1e-9:
            start = i - width + 1
            if out and out[-1][1] >= start:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(text: str, width: int = 20, thresholds: dict[str, float] | None = None, allowed: re.Pattern | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of stretches of high entropy in candidate strings that aren't on the allow-list.

    A candidate without a digit counts only where its case changes about as often as by chance (`mixed`): words, and names
    made of capitalised words, have entropies as high as random letters, and random small letters can't be told from words.
    """
    thresholds = thresholds or THRESHOLDS
    allowed = allowed or _ALLOWED
    out = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if not (mixed(s) or any(c.isdigit() for c in s)) or allowed.fullmatch(s):
            continue
        kind = next(k for k, p in _CLASSES if p.fullmatch(s))
        at = m.start()
        for piece in [*PLACEHOLDER.finditer(s), None]:
            stop = m.start() + piece.start() if piece else m.end()
            out += [(at + a, 3, at + b) for a, b in hot_windows(text[at:stop], width, thresholds[kind])]
            at = m.start() + piece.end() if piece else stop
    return out


def mixed(s: str) -> bool:
    """Whether capitals are 3 to 7 in 10 of the letters and follow small ones in one of six places at least."""
    up = sum(c.isupper() for c in s)
    letters = up + sum(c.islower() for c in s)
    return 0.3 * letters <= up <= 0.7 * letters and 6 * sum(a.islower() and b.isupper() for a, b in zip(s, s[1:], strict=False)) >= len(s)


_ALLOWED = re.compile("|".join(f"(?:{p})" for p in ALLOWED))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """One row per row of `df`: id, and spans array<struct<kind, start, end>> (code points, end exclusive).

    Spans are in order of start, then of `KINDS`. Null and empty texts have none; a repeated row is answered again;
    other columns are ignored. Every text is scanned whole.
    """

    def batch(cols):
        spans = []
        for t in cols["text"]:
            t = t or ""
            spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base_spans(t) + entropy_spans(t, width))])
        yield {"id": cols["id"], "spans": spans}

    kind = df.schema[id_col].dataType.simpleString()
    out = map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), batch, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>", text="text")
    return out.select(F.col("id").alias(id_col), "spans")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    from lectern.llm.common import table

    s = scan_secrets(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("bigint")
    return s.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(F.filter("spans", lambda x: x.kind != "entropy")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("entropy").alias("n_entropy"))
