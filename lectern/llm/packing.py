"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import os
import random
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import NOT_PLAIN
from lectern.llm.common import cut, map_arrow, table

CAPACITY = 1024
#: Items that a shard has on average; its islands evolve packings of just these. A shard wastes under one sequence.
SHARD = 16_384
ISLANDS, EPOCHS, POPULATION, ELITE = 2, 2, 8, 2
#: An epoch breeds generations until the least possible number of bins is reached, or PATIENCE generations brought nothing,
#: or about WORK items were placed, whichever comes first; a larger shard needs fewer, for its best fits are closer.
WORK, PATIENCE = 800_000, 60


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(4)
def _fast(path: str, pattern: str):
    """The tokenizer of a byte-level BPE file as two faster encoders, or None if the file is of another kind.

    Its merges must be in order of their ids; then ids are ranks, and the same pairs merge in the same order. The
    second encoder is for texts in which no white space follows other white space: it needs no look-ahead.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    byte_of = {}
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        byte_of[chr(b if shown else 256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x) for x in range(b)))] = b
    special = {t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if i not in special}
    ids = [model["vocab"]["".join(m.split(" ", 1) if isinstance(m, str) else m)] for m in model["merges"]]
    if ids != sorted(ids):
        return None
    make = lambda name, p: tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
    tail = r"|\s+(?!\S)|\s+"
    return make("whole", pattern), make("single", pattern.replace(tail, r"|\s")) if pattern.endswith(tail) else make("again", pattern)


_DOUBLE = [a + b for a in " \t\n\r" for b in " \t\n\r"]


def token_bytes(texts: list[str], path: str, pattern: str | None) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, without special tokens.

    With `pattern`, by which the tokenizer itself splits, texts of common characters go to a faster encoder.
    """
    fast = _fast(path, pattern) if pattern else None
    rest = [i for i, t in enumerate(texts) if fast is None or NOT_PLAIN.search(t)]
    out: list[bytes] = [b""] * len(texts)
    if rest:
        for i, e in zip(rest, _tokenizer(path).encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
    other = set(rest)
    for i, t in enumerate(texts):
        if i not in other:
            out[i] = np.array(fast[not any(d in t for d in _DOUBLE)].encode_ordinary(t), "<u4").tobytes()
    return out


def cut_pieces(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; the first takes what doesn't fill one."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def tokenised(df: DataFrame, path: str, eos: int, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each row's ids and `eos`."""

    def batch(cols):
        end = np.array([eos], "<u4").tobytes()
        out = {"id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for i, ids in zip(cols["id"], token_bytes([t or "" for t in cols["text"]], path, pattern), strict=True):
            found = cut_pieces(ids + end, capacity)
            out["id"] += [i] * len(found)
            out["piece"] += range(len(found))
            for name, values in zip(("start", "length", "ids_crc32"), zip(*found, strict=True), strict=True):
                out[name] += values
        yield out

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), batch, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", text="text", chars=2_000_000)


class Packing:
    """Bins of item numbers with the space left in each; `by_space` finds the fullest bin that an item fits in."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] = ()):
        self.sizes, self.capacity = sizes, capacity
        self.bins = [list(b) for b in bins]
        self.space = [capacity - sum(sizes[i] for i in b) for b in self.bins]

    def best_fit(self, items: list[int]) -> "Packing":
        """Puts the items, in the order given, each into the open bin that it fills best, or into a new one."""
        stacks: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_ = 0
        for b, s in enumerate(self.space):
            if s:
                stacks[s].append(b)
                open_ |= 1 << s
        sizes, bins, space = self.sizes, self.bins, self.space
        for i in items:
            n = sizes[i]
            fits = open_ >> n
            if fits:
                s = n + (fits & -fits).bit_length() - 1
                b = stacks[s].pop()
                if not stacks[s]:
                    open_ ^= 1 << s
                bins[b].append(i)
                s -= n
                space[b] = s
            else:
                b, s = len(bins), self.capacity - n
                bins.append([i])
                space.append(s)
            if s:
                stacks[s].append(b)
                open_ |= 1 << s
        return self

    def exact_fit(self, rng: random.Random | None = None) -> "Packing":
        """Packs all items anew: each bin begins with the largest one left, and takes one or two that fill it, else the
        largest that fits, until none does. `rng` now and then prefers another pair.

        Bit n of `have` says that an item of size n is left, and bit capacity - n of `back`, so that one shift and one
        conjunction find every pair of sizes with a given sum.
        """
        cap = self.capacity
        left: list[list[int]] = [[] for _ in range(cap + 1)]
        for i, n in enumerate(self.sizes):
            left[n].append(i)
        have = back = 0
        for n in range(1, cap + 1):
            if left[n]:
                have |= 1 << n
                back |= 1 << (cap - n)
        self.bins, self.space = [], []

        def take(n: int, into: list[int]) -> None:
            nonlocal have, back
            into.append(left[n].pop())
            if not left[n]:
                have ^= 1 << n
                back ^= 1 << (cap - n)

        while have:
            own: list[int] = []
            room = cap
            while room and (fits := have & ((2 << room) - 1)):
                if own:
                    if fits >> room & 1:
                        take(room, own)
                        room = 0
                        break
                    pairs = fits & (back >> (cap - room))
                    if rng is not None and rng.random() < 0.3:
                        pairs = pairs & ((2 << rng.randint(1, room)) - 1) or pairs
                    a = pairs.bit_length() - 1
                    if a > 0 and (2 * a != room or len(left[a]) > 1):
                        take(a, own)
                        take(room - a, own)
                        room = 0
                        break
                n = fits.bit_length() - 1
                take(n, own)
                room -= n
            self.bins.append(own)
            self.space.append(room)
        return self

    def cost(self) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones: a nearly empty bin is nearly gone."""
        return len(self.bins), -sum((self.capacity - s) ** 2 for s in self.space)

    def crossover(self, other: Packing, rng: random.Random) -> Packing:
        """A child that takes whole well-filled bins of `other`, loses its own bins that hold any of their items, and
        best-fits what those leave without a place."""
        good = sorted(range(len(other.bins)), key=lambda b: (other.space[b], rng.random()))
        taken = [b for b in good[: max(1, len(good) // 2)] if rng.random() < 0.5] or good[:1]
        new = {i for b in taken for i in other.bins[b]}
        kept, lost = [], []
        for b in self.bins:
            if new.isdisjoint(b):
                kept.append(b)
            else:
                lost += [i for i in b if i not in new]
        child = Packing(self.sizes, self.capacity, kept + [other.bins[b] for b in taken])
        return child.best_fit(sorted(lost, key=lambda i: -self.sizes[i]))

    def mutated(self, rng: random.Random) -> Packing:
        """Empties the least filled bins and some at random, and best-fits their items anew."""
        order = sorted(range(len(self.bins)), key=lambda b: -self.space[b])
        gone = {*order[: max(1, len(order) // 50)], *rng.sample(order, max(1, len(order) // 50))}
        lost = [i for b in gone for i in self.bins[b]]
        lost.sort(key=lambda i: (-self.sizes[i] + rng.randrange(8), i))
        return Packing(self.sizes, self.capacity, [b for k, b in enumerate(self.bins) if k not in gone]).best_fit(lost)


def least_bins(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing can be under (Martello and Toth 1990): for every k, items that no item of k or more
    fits beside have bins of their own, and those of k to half a bin share what is left."""
    n = np.bincount(np.array(sizes, np.int64), minlength=capacity + 1)
    count, total = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(1, half + 1)
    alone = count[-1] - count[capacity - k]
    large, in_large = count[capacity - k] - count[half], total[capacity - k] - total[half]
    small = total[half] - total[k - 1]
    return int((alone + large + np.maximum(0, -(-(small - large * capacity + in_large) // capacity))).max(initial=0))


def evolve(sizes: list[int], capacity: int, seed: int, start: list[list[list[int]]] = (), work: int = WORK, patience: int = PATIENCE, population: int = POPULATION) -> list[Packing]:
    """An island's packings, best first, after some generations; ends early at the least possible number of bins."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    least = least_bins(sizes, capacity)
    pool = [Packing(sizes, capacity, bins) for bins in start]
    while len(pool) < population and not any(len(p.bins) == least for p in pool):
        new = Packing(sizes, capacity)
        pool.append(new.best_fit(order) if not pool else new.exact_fit(rng if len(pool) > 1 or seed % 2 else None))
    pool.sort(key=Packing.cost)
    idle = 0
    for _ in range(max(1, work // max(1, len(sizes) * population)) if work else 0):
        if len(pool[0].bins) <= least or len(pool) < 2 or idle >= patience:
            break
        children = []
        for _ in range(population):
            a, b = rng.sample(pool, 2)
            child = a.crossover(b, rng)
            children.append(child.mutated(rng) if rng.random() < 0.5 else child)
        before = pool[0].cost()
        pool = sorted(pool + children, key=Packing.cost)[:population]
        idle = 0 if pool[0].cost() < before else idle + 1
    return pool


def assignment(p: Packing) -> list[int]:
    out = [0] * len(p.sizes)
    for b, items in enumerate(p.bins):
        for i in items:
            out[i] = b
    return out


def bins_of(assigned: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, b in enumerate(assigned):
        out[b].append(i)
    return out


def epoch(islands: DataFrame, number: int, capacity: int) -> DataFrame:
    """One epoch on every island: (shard, island, bins, elite): the number of bins of its best, and its best packings."""

    def batch(cols):
        out = {"shard": [], "island": [], "items": [], "sizes": [], "bins": [], "elite": []}
        for shard, island, items, sizes, elite in zip(cols["shard"], cols["island"], cols["items"], cols["sizes"], cols["elite"], strict=True):
            pool = evolve(sizes, capacity, hash((shard, island, number)), [bins_of(e) for e in elite])
            for name, value in zip(out, (shard, island, items, sizes, len(pool[0].bins), [assignment(p) for p in pool[:ELITE]]), strict=True):
                out[name].append(value)
        yield out

    return map_arrow(islands, batch, "shard bigint, island int, items array<bigint>, sizes array<int>, bins int, elite array<array<int>>")


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, n_islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(item, sequence_id, offset) for `items` (item: unique long, length from 1 to `capacity`).

    Full items are alone. Others are dealt by hash to shards of about `shard` items, whose number grows with the
    input. On each shard several islands evolve packings of its items from different seeds; after each epoch an
    island gets the elite of its neighbour on the shard; the best packing of all stays. No task holds more than
    a shard, and islands that are lost with their executor are evolved again from the same seed.
    """
    full = items.where(F.col("length") == capacity).select("item", (F.col("item") * 2).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    part = items.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard))
    held = part.groupBy((F.pmod(F.xxhash64("item"), F.lit(shards))).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("x"))
    held = held.select("shard", F.col("x.item").alias("items"), F.col("x.length").cast("array<int>").alias("sizes"))
    none = F.array().cast("array<array<int>>")
    state = held.select("shard", F.explode(F.array(*map(F.lit, range(n_islands)))).alias("island"), "items", "sizes", none.alias("elite"))
    for number in range(epochs):
        state = cut(epoch(state.repartition(max(1, min(shards * n_islands, 10_000)), "shard", "island"), number, capacity))
        if number + 1 < epochs:
            from_next = state.select("shard", F.pmod(F.col("island") + 1, F.lit(n_islands)).cast("int").alias("island"), F.col("elite").alias("migrants"))
            state = state.join(from_next, ["shard", "island"]).select("shard", "island", "items", "sizes", F.concat("elite", "migrants").alias("elite"))
    best = state.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("best"))
    state = state.join(best, "shard").where("island = best.island")
    rows = state.select("shard", F.explode(F.arrays_zip("items", "sizes", F.col("elite")[0].alias("bin"))).alias("x"))
    rows = rows.select(F.col("x.items").alias("item"), F.col("x.sizes").cast("bigint").alias("length"), (F.shiftleft("shard", 32) + F.col("x.bin")).alias("bin"))
    from pyspark.sql import Window

    before = Window.partitionBy("bin").orderBy("item")
    placed = rows.select("item", (F.col("bin") * 2 + 1).alias("sequence_id"), (F.sum("length").over(before) - F.col("length")).alias("offset"))
    return full.union(placed)


def pack_documents(df: DataFrame, path: str, eos: int, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end token. Only documents of over `capacity` ids are cut. Every row is
    packed, repeated ones too (pieces are told apart by row, not by id); an empty table gives no rows; other columns
    are ignored.
    """
    found = tokenised(df, path, eos, pattern, id_col, text_col, capacity)
    rows = cut(found.withColumn("item", F.monotonically_increasing_id()))
    places = pack(rows.select("item", "length"), capacity)
    out = rows.join(places, "item")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, public_tokenizers.PATTERN)
