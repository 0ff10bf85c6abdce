"""From a model's scores to a dependency tree: label masks, spanning trees with one root, words from word pieces."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

GOESWITH = "X|_|goeswith"
#: Positions of a row besides its pieces: start, end and the masked piece again.
EXTRA = 3


class ModelError(ValueError):
    """A model that can't be used, and why."""


@dataclass
class Labels:
    """A model's labels, `UPOS|...|DEPREL`. The first marks nothing; those that end in `|root` mark a root."""

    names: list[str]

    def __post_init__(self):
        self.root = np.array([i > 0 and n.endswith("|root") for i, n in enumerate(self.names)])
        self.relation = ~self.root
        self.relation[0] = False
        self.goeswith = self.names.index(GOESWITH)
        self.joins = np.array([n.rsplit("|", 1)[-1] == "goeswith" for n in self.names])

    @classmethod
    def from_config(cls, text: str) -> "Labels":
        try:
            found = json.loads(text).get("id2label")
        except (json.JSONDecodeError, AttributeError) as e:
            raise ModelError(f"not JSON: {e}") from e
        if not isinstance(found, dict):
            raise ModelError('no "id2label"')
        names = []
        for i in range(len(found)):
            if str(i) not in found:
                raise ModelError(f"no label {i}")
            name = found[str(i)]
            if not isinstance(name, str) or "|" not in name:
                raise ModelError(f"the label {name} is not UPOS|...|DEPREL")
            names.append(name)
        if GOESWITH not in names:
            raise ModelError(f'no label "{GOESWITH}"')
        out = cls(names)
        if not out.root.any():
            raise ModelError('no "...|root" label')
        if not (out.relation & (np.arange(len(names)) != out.goeswith)).any():
            raise ModelError("no relation label besides goeswith")
        return out


def max_pieces(config: str) -> int:
    """Pieces that a sentence may have, from the model's configuration."""
    c = json.loads(config)
    for key in ("max_position_embeddings", "pad_token_id"):
        if not isinstance(c.get(key), int) or isinstance(c[key], bool) or c[key] < 0:
            raise ModelError(f'no non-negative integer "{key}"')
    positions = c["max_position_embeddings"] - c["pad_token_id"] - 1
    if positions <= EXTRA:
        raise ModelError(f'"max_position_embeddings" {c["max_position_embeddings"]} leaves no piece after "pad_token_id" {c["pad_token_id"]}')
    return positions - EXTRA


def masked_rows(start: int, sep: int, mask: int, pieces: list[int], rows: range) -> np.ndarray:
    """The model's input rows: the sentence with piece i masked, and piece i after its end."""
    ids = np.tile(np.array([start, *pieces, sep, 0], np.int64), (len(rows), 1))
    for k, i in enumerate(rows):
        ids[k, 1 + i], ids[k, -1] = mask, pieces[i]
    return ids


def spanning_forest(score: np.ndarray) -> np.ndarray:
    """Heads of the maximum spanning forest. score[h, d] is h heading d, score[d, d] is d being a root; a root heads itself.

    Each node takes its best head; while these make a cycle, it is contracted to one node, whose incoming scores are
    what entering the cycle at a node gains over the node's own head (Chu and Liu; Edmonds).
    """
    n = len(score)
    heads = score.argmax(0)
    cycle = _cycle(heads)
    if cycle is None:
        return heads
    rest = np.array([i for i in range(n) if i not in set(cycle)], int)
    c = np.array(cycle)
    own = score[heads[c], c]
    m = len(rest)
    small = np.empty((m + 1, m + 1), score.dtype)
    small[:m, :m] = score[np.ix_(rest, rest)]
    gain_in = score[np.ix_(rest, c)] - own[None, :]
    gain_root = score[c, c] - own
    small[:m, m] = gain_in.max(1) if m else []
    small[m, m] = gain_root.max()
    out_scores = score[np.ix_(c, rest)]
    small[m, :m] = out_scores.max(0) if m else []
    solved = spanning_forest(small)
    out = heads.copy()
    for k, d in enumerate(rest):
        h = solved[k]
        out[d] = c[out_scores[:, k].argmax()] if h == m else rest[h]
    enter = int(gain_root.argmax()) if solved[m] == m else int(gain_in[solved[m]].argmax())
    out[c[enter]] = c[enter] if solved[m] == m else rest[solved[m]]
    return out


def first_forest(score: np.ndarray) -> np.ndarray:
    """The same, exactly, and of forests of equal score the one whose heads come first, compared node by node.

    Scores become whole numbers, for finite ones are multiples of a power of two. Each arc loses its head's digit to the base n
    at its node's place, so that no two forests are alike. Where that takes more than 64 bits, a bonus on all arcs but the
    best forest's first tells whether another is as good.
    """
    n = len(score)
    parts = [x.as_integer_ratio() if math.isfinite(x) else (x, 1) for x in score.ravel().tolist()]
    unit = max(d for _, d in parts)
    whole = [x if isinstance(x, float) else x * (unit // d) for x, d in parts]
    finite = [x for x in whole if not isinstance(x, float)] or [0]
    if len(finite) < len(whole):
        # an arc of infinite score counts more than all finite ones of a forest
        low, high = min(finite), max(finite)
        beyond = 1 + n * (high - low)
        whole = [x if not isinstance(x, float) else high + beyond if x > 0 else low - beyond for x in whole]
    most, every = 1 + max(map(abs, whole)), n**n

    def forest(values: list[int], factor: int) -> np.ndarray:
        # sums of a contraction are below 4n times the largest score
        kind = np.int64 if 4 * n * most * factor < 2**63 else object
        return spanning_forest(np.array(values, kind).reshape(n, n))

    if 4 * n * most * every >= 2**63:
        heads = forest(whole, 1)
        first = heads.tolist()
        if (forest([x * (n + 1) + (first[i % n] != i // n) for i, x in enumerate(whole)], n + 1) == heads).all():
            return heads
    return forest([x * every - i // n * n ** (n - 1 - i % n) for i, x in enumerate(whole)], every)


def _cycle(heads: np.ndarray) -> list[int] | None:
    done: set[int] = set()
    for start in range(len(heads) - 1, -1, -1):
        path: list[int] = []
        at = start
        while at not in done and at not in path and heads[at] != at:
            path.append(at)
            at = int(heads[at])
        if at in path:
            return path[path.index(at) :]
        done.update(path)
        done.add(at)
    return None


def roots(heads: np.ndarray) -> list[int]:
    return np.flatnonzero(heads == np.arange(len(heads))).tolist()


def one_root(best: np.ndarray, forest: Callable[[np.ndarray], np.ndarray] = spanning_forest) -> np.ndarray:
    """Heads of a spanning tree: of several roots the best stays, the others are made dear, then impossible."""
    heads = forest(best)
    several = roots(heads)
    if len(several) <= 1:
        return heads
    keep = several[int(best[several, several].argmax())]
    dear = best.copy()
    penalty = best.min() - best.max()
    among = np.isin(np.arange(len(best)), several)
    for d in several:
        spared = among.copy()
        spared[d] = d == keep
        dear[~spared, d] += penalty
    heads = forest(dear)
    if len(roots(heads)) <= 1:
        return heads
    other = np.arange(len(best)) != keep
    dear[other, other] = -np.inf
    return forest(dear)


def parse_pieces(scores: np.ndarray, labels: Labels) -> tuple[np.ndarray, np.ndarray]:
    """(heads, labels) of the pieces from scores[head, dependent, label]."""
    n = len(scores)
    s = scores.astype(np.float32, copy=True)
    own = np.eye(n, dtype=bool)
    s[own[:, :, None] & ~labels.root] = -np.inf
    s[~own[:, :, None] & ~labels.relation] = -np.inf
    best = s.max(2)
    top, head_of = s.argmax(2), best.argmax(0)
    # goeswith goes to the right neighbour only, or on through neighbours that go with the same head
    for h in range(n):
        free = h + 1
        while free < n - 1 and top[h, free] == labels.goeswith and head_of[free] == h:
            free += 1
        allowed = np.zeros(n, bool)
        allowed[h + 1 : free + 1] = True
        s[h, ~allowed, labels.goeswith] = -np.inf
    heads = one_root(s.max(2))
    return heads, s[heads, np.arange(n)].argmax(1)


def decode(scores: np.ndarray, labels: Labels, sentence: str, pieces: list[tuple[int, int]]) -> list[dict]:
    """Tokens of the sentence from the scores of its pieces (character ranges)."""
    heads, own = parse_pieces(scores, labels)
    words = [[a, b, int(h), int(k)] for (a, b), h, k in zip(pieces, heads, own, strict=True)]
    for i in range(len(words) - 1, 0, -1):
        head = words[i][2]
        if head < i and all(labels.joins[w[3]] for w in words[head + 1 : i + 1]):
            words[i - 1][1] = words[i][1]
            del words[i]
            for w in words:
                w[2] -= w[2] >= i
    out = []
    for k, (a, b, head, label) in enumerate(words):
        fields = labels.names[label].split("|")
        out.append({"id": k + 1, "form": sentence[a:b], "lemma": "_", "upostag": fields[0], "head": 0 if head == k else head + 1, "deprel": fields[-1]})
    return out
