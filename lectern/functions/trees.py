"""Dependency trees of one sentence: validity, projection on content, distances, embeddings, passives.

A token is a dict with id, form, lemma, upostag, head (0: root) and deprel, as in CoNLL-U.
"""

from __future__ import annotations

import re

CLAUSAL = frozenset({"advcl", "acl", "csubj", "ccomp"})
SUBJECTS = frozenset({"nsubj", "nsubj:pass"})
_ALNUM = re.compile(r"[^\W_]")


def tree_error(tokens: list[dict]) -> str | None:
    """The first of Empty, IdOutOfOrder, HeadOutOfRange, SeveralRoots and Cycle that holds, or None."""
    n = len(tokens)
    if not n:
        return "Empty"
    if [t["id"] for t in tokens] != list(range(1, n + 1)):
        return "IdOutOfOrder"
    if any(not 0 <= t["head"] <= n for t in tokens):
        return "HeadOutOfRange"
    if sum(t["head"] == 0 for t in tokens) > 1:
        return "SeveralRoots"
    rooted = {0}
    for t in tokens:
        path, at = [], t["id"]
        while at not in rooted:
            if at in path:
                return "Cycle"
            path.append(at)
            at = tokens[at - 1]["head"]
        rooted.update(path)
    return None


def content(tokens: list[dict]) -> list[dict]:
    """The tokens but punctuation, renumbered from 1 as `cid`; `chead` is the nearest ancestor among them, 0 if none."""
    number, last = {}, 0
    for t in tokens:
        if t["upostag"] != "PUNCT":
            last += 1
            number[t["id"]] = last
    out = []
    for t in tokens:
        if t["id"] in number:
            at = t["head"]
            while at and at not in number:
                at = tokens[at - 1]["head"]
            out.append({**t, "cid": number[t["id"]], "chead": number.get(at, 0)})
    return out


def dependency_distance(tree: list[dict]) -> tuple[int, int]:
    """(sum of |position - head's position|, how many) over the content tokens that have a head."""
    gaps = [abs(t["cid"] - t["chead"]) for t in tree if t["chead"]]
    return sum(gaps), len(gaps)


def depths(tree: list[dict]) -> list[int]:
    """Edges from each content token to its projected root."""
    known = {0: -1}
    for t in tree:
        path, at = [], t["cid"]
        while at not in known:
            path.append(at)
            at = tree[at - 1]["chead"]
        for up, node in enumerate(reversed(path), 1):
            known[node] = known[at] + up
    return [known[t["cid"]] for t in tree]


def is_clausal(deprel: str) -> bool:
    return deprel.split(":", 1)[0] in CLAUSAL


def spans(tree: list[dict]) -> list[tuple[int, int]]:
    """First and last position of each content token's subtree; the deepest report to their heads first."""
    low = list(range(len(tree) + 1))
    high = low[:]
    for _, t in sorted(zip(depths(tree), tree, strict=True), key=lambda x: -x[0]):
        if t["chead"]:
            low[t["chead"]] = min(low[t["chead"]], low[t["cid"]])
            high[t["chead"]] = max(high[t["chead"]], high[t["cid"]])
    return list(zip(low[1:], high[1:], strict=True))


def center_embeddings(tokens: list[dict], tree: list[dict]) -> list[dict]:
    """Subjects parted from their verb by a whole clause: forms, and the words between them."""
    clauses = [s for t, s in zip(tree, spans(tree), strict=True) if is_clausal(t["deprel"])]
    out = []
    for t in tree:
        subject, verb = t["cid"], t["chead"]
        if t["deprel"] in SUBJECTS and subject < verb and any(subject < lo and hi < verb for lo, hi in clauses):
            v = tree[verb - 1]
            between = sum(bool(_ALNUM.search(x["form"])) for x in tokens if t["id"] < x["id"] < v["id"])
            out.append({"subject": t["form"], "verb": v["form"], "words_between": between})
    return out


def passive_heads(tokens: list[dict]) -> list[int]:
    return sorted({t["head"] for t in tokens if t["deprel"] == "aux:pass" and t["head"]})


def align(forms: list[str], text: str) -> list[int | None]:
    """Where each form begins in the text, in order: at the next word, else at a later start of a word; a form that
    isn't found has none and moves nothing."""
    out: list[int | None] = []
    at = 0
    for form in forms:
        while at < len(text) and text[at].isspace():
            at += 1
        found = None
        if text.startswith(form, at):
            found = at
        else:
            found = next((m.end() for m in re.compile(r"\s").finditer(text, at) if text.startswith(form, m.end())), None)
        out.append(found)
        if found is not None:
            at = found + len(form)
    return out


def passives(tokens: list[dict], text: str) -> list[dict]:
    """The passive heads' forms and their character offsets in the sentence (None where not found)."""
    where = align([t["form"] for t in tokens], text)
    return [{"verb": tokens[h - 1]["form"], "at": where[h - 1]} for h in passive_heads(tokens)]
