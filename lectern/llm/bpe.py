"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_arrow, table

#: No pair of tokens merges.
NONE = np.iinfo(np.int32).max
#: Bytes up to which pieces go to matrices. Longer ones, whose rows would need as many rounds, merge by a heap.
LONGEST = 128
#: Pieces whose ids a worker remembers; it forgets all of them when there are more.
REMEMBERED = 150_000
#: Texts without these characters are split alike by `re` and `regex`, the first being twice as fast.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7eÀ-ž‐-’“”…€]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@lru_cache(4)
def _whole(pattern: str):
    return regex.compile(pattern)


def pieces(text: str, pattern: str) -> list[str]:
    """The matches of `pattern` (the public one of these vocabularies, or any other)."""
    from public_tokenizers import PATTERN

    return _FAST.findall(text) if pattern == PATTERN and not NOT_PLAIN.search(text) else _whole(pattern).findall(text)


class Vocabulary:
    """Ranks by token bytes, and a hash table of token pairs: (left, right) -> the rank of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self._build((np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64), np.array(rank, np.int32))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, key: np.ndarray, rank: np.ndarray) -> None:
        """Open addressing with linear probing, filled by rounds: of the pairs that want a free slot, one gets it."""
        self.bits = max(4, int(np.ceil(np.log2(4 * len(key) + 1))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.values[slot] == NONE
            self.keys[slot[free]] = key[free]
            got = free & (self.keys[slot] == key)
            self.values[slot[got]] = rank[got]
            key, rank, slot = key[~got], rank[~got], (slot[~got] + 1) & ((1 << self.bits) - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `NONE` where it doesn't merge. Negative ids are padding."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = (left.ravel()[at].astype(np.uint64) << np.uint64(32)) | right.ravel()[at].astype(np.uint64)
        slot, flat = self._slot(key), out.reshape(-1)
        while len(at):
            value, hit = self.values[slot], self.keys[slot] == key
            flat[at[hit]] = value[hit]
            go = ~hit & (value != NONE)
            at, key, slot = at[go], key[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_rows(self, rows: list[bytes]) -> list[list[int]]:
        """Ids of each of `rows`. Rows of like length share a matrix; each round every row merges its leftmost pair of
        minimum rank and closes the gap; rows without a pair leave the matrix."""
        out: list[list[int]] = [[]] * len(rows)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        bucket = np.where(size <= 8, 8, 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
        for width in np.unique(bucket).tolist():
            own = np.flatnonzero(bucket == width)
            for at in range(0, len(own), 20_000):
                self._matrix(own[at : at + 20_000], rows, width, out)
        return out

    def _matrix(self, own: np.ndarray, rows: list[bytes], width: int, out: list[list[int]]) -> None:
        raw = np.frombuffer(b"".join(rows[i].ljust(width, b"\0") for i in own.tolist()), np.uint8).reshape(-1, width)
        size = np.fromiter((len(rows[i]) for i in own.tolist()), np.int64, len(own))
        ids = np.where(np.arange(width) < size[:, None], self.byte[raw], -1).astype(np.int32)
        rank = self.lookup(ids[:, :-1], ids[:, 1:])
        pad = np.full((len(own), 1), -1, np.int32)
        rank = np.concatenate([rank, np.full_like(pad, NONE)], axis=1)
        column = np.arange(width)
        while len(own):
            at = rank.argmin(1)  # the first of equals
            row = np.arange(len(own))
            best = rank[row, at]
            done = best == NONE
            if done.any():
                for i, n, r in zip(own[done].tolist(), size[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = r[:n]
                own, size, ids, rank, at, best = (x[~done] for x in (own, size, ids, rank, at, best))
                row = np.arange(len(own))
                if not len(own):
                    break
            ids[row, at] = best
            after = column[None, :] > at[:, None]
            ids[:, :-1] = np.where(after[:, :-1], ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            size -= 1
            ids[row, size] = -1
            rank[row, np.minimum(size, width - 1)] = NONE
            nxt = np.minimum(at + 1, width - 1)
            rank[row, at] = self.lookup(ids[row, at], np.where(at + 1 < width, ids[row, nxt], -1))
            before = np.maximum(at - 1, 0)
            rank[row, before] = np.where(at > 0, self.lookup(np.where(at > 0, ids[row, before], -1), ids[row, at]), rank[row, before])

    def merge_long(self, row: bytes) -> list[int]:
        """Ids of one long piece: the same merges in the same order, kept in a heap of (rank, place)."""
        ids = self.byte[np.frombuffer(row, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.lookup(np.array(ids[:-1]), np.array(ids[1:])).tolist() + [NONE]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)

        def again(i):
            j = after[i]
            rank[i] = self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]], NONE) if j < n else NONE
            if rank[i] != NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            again(i)
            if before[i] >= 0:
                again(before[i])
        return [x for x in ids if x >= 0]

    def encode_pieces(self, words: list[str]) -> list[list[int]]:
        """Ids of each piece. A piece that is a token itself is that token, whatever its merges would give."""
        raw = [w.encode() for w in words]
        out = [[r] if (r := self.ranks.get(b)) is not None else None for b in raw]
        short = [i for i, x in enumerate(out) if x is None and len(raw[i]) <= LONGEST]
        for i, x in zip(short, self.merge_rows([raw[i] for i in short]), strict=True):
            out[i] = x
        return [x if x is not None else self.merge_long(raw[i]) for i, x in enumerate(out)]

    def encode_batch(self, texts: list[str], pattern: str, known: dict[str, list[int]]) -> list[list[int]]:
        """Ids of each text. Pieces are encoded once each and remembered in `known`."""
        split = [pieces(t, pattern) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in set(chain.from_iterable(split)) if w not in known]
        known.update(zip(new, self.encode_pieces(new), strict=True))
        return [list(chain.from_iterable(map(known.__getitem__, s))) for s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a rank file (base64 token and rank by line), once in each worker."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


_known: dict[str, dict[str, list[int]]] = {}


def bpe_encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, ids array<int>) for each row, or with `digest` (id, n_tokens, ids_sha256, decoded_sha256) instead.

    Ids are those of tiktoken's `encode_ordinary` for the ranks at `path` (a file that every worker has). Null and
    empty texts have no ids; texts are taken whole; repeated rows are answered again; other columns are ignored.
    """
    import hashlib

    def batch(cols):
        v, known = load(path), _known.setdefault(path, {})
        ids = v.encode_batch([t or "" for t in cols["text"]], pattern, known)
        if not digest:
            yield {"id": cols["id"], "ids": ids}
            return
        sha = lambda b: hashlib.sha256(b).hexdigest()
        yield {"id": cols["id"], "n_tokens": [len(x) for x in ids], "ids_sha256": [sha(",".join(map(v.decimal.__getitem__, x)).encode()) for x in ids], "decoded_sha256": [sha(v.decode(x)) for x in ids]}

    kind = df.schema[id_col].dataType.simpleString()
    rest = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), batch, f"id {kind}, {rest}", text="text", chars=2_000_000).withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) for each row of ids, as `bpe_encode` gives them; null ids give no bytes."""

    def batch(cols):
        v = load(path)
        yield {"id": cols["id"], "bytes": [v.decode(x or []) for x in cols["ids"]]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), batch, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def bpe_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
