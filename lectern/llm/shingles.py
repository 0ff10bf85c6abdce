"""Near copies by word shingles: all pairs of a Jaccard similarity, exactly.

Candidates share a shingle of their prefixes (Chaudhuri et al. 2006, Bayardo et al. 2007); the first may come from the
caller's fingerprints too. Pairs go by their sizes, by the Hamming distance of parity fingerprints and, in large buckets, by
tables of distances to pivots; all three bounds are exact. Survivors are verified on the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import components, cut, join_checked, map_arrow

WORDS = 5
#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Texts, about, and shingles that the order of shingles is made of. Any order gives the same links; one that puts common shingles last has the fewest candidates.
SAMPLE, COMMON = 4_000, 50_000
#: Rounds in which each text meets the first text of each bucket; after that all pairs meet that aren't linked yet.
ROUNDS = 2
#: A bucket of more rows gets fingerprints and pivots before its pairs are formed; one of over BLOCK rows is dealt to blocks of that size in pairs.
SMALL, BLOCK, PIVOTS = 32, 2_048, 8
#: Rows and shingles of a block of a cluster, whose rows carry their sets.
WIDE, HEAVY = 8_192, 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte whether it is white space and its number (capitals as small letters); powers of a base, and of its inverse."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    number = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
    number[ord("A") : ord("Z") + 1] = number[ord("a") : ord("z") + 1]
    base = 0x9E3779B97F4A7C17
    powers = [np.cumprod(np.r_[np.uint64(1), np.full(_STEP, b, np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]
    return space, number, *powers


_SPACE, _NUMBER, _POWER, _INVERSE = _tables()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of `data`: a polynomial of its bytes modulo 2 ** 64, from differences of running sums."""
    starts, ends, before, after = [], [], [], []
    total, scale, inside = np.uint64(0), np.uint64(1), False
    for at in range(0, len(data) + 1, _STEP):
        b = np.frombuffer(data[at : at + _STEP] + b" " * (at + _STEP > len(data)), np.uint8)
        sums = np.r_[total, total + np.cumsum(_NUMBER[b] * _POWER[: len(b)] * scale, dtype=np.uint64)]
        word = np.r_[inside, ~_SPACE[b]]
        first, last = np.flatnonzero(~word[:-1] & word[1:]), np.flatnonzero(word[:-1] & ~word[1:])
        starts.append(first + at)
        before.append(sums[first])
        after.append(sums[last])
        total, scale, inside = sums[-1], scale * _POWER[_STEP], word[-1]
    start = np.concatenate(starts)
    blocks = np.cumprod(np.r_[np.uint64(1), np.full(len(data) // _STEP, _INVERSE[_STEP], np.uint64)], dtype=np.uint64)
    return start, (np.concatenate(after) - np.concatenate(before)) * _INVERSE[start % _STEP] * blocks[start // _STEP]


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Each text's different k-word shingles as sorted 64-bit hashes; a shorter text is one shingle, one without a word has none."""
    with np.errstate(over="ignore"):
        start, w = word_hashes(b" ".join(texts))
        edges = np.searchsorted(start, np.cumsum([0, *[len(t) + 1 for t in texts]]))
        n = max(0, len(w) - k + 1)
        h = w[:n]
        for i in range(1, k):
            h = mixed(h) + w[i : i + n]
        h = mixed(h)
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(h[a : b - k + 1])
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                out.append(s[new])
            else:
                out.append(np.array([xxhash.xxh64_intdigest(w[a:b].tobytes(), b - a)] if b > a else [], np.uint64))
    return out


class Order:
    """An order of shingles: those of the sample by how many texts have them, after all others."""

    def __init__(self, shingle: np.ndarray, count: np.ndarray):
        self.shingle, self.count = shingle, count
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[shingle >> np.uint64(44)] = True

    def prefix(self, s: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
        """The first shingles of a set: two sets of similarity `least` share one of these."""
        n = len(s)
        size = n - -(-n * least[0] // least[1]) + 1 if n else 0
        known = self.maybe[s >> np.uint64(44)]
        if known.any():
            near = np.flatnonzero(known)
            at = np.minimum(np.searchsorted(self.shingle, s[near]), len(self.shingle) - 1)
            hit = self.shingle[at] == s[near]
            known[near[~hit]] = False
            rare = s[~known]
            if len(rare) < size:
                own, count = s[known], self.count[at[hit]]
                return np.concatenate([rare, own[np.lexsort((own, count))]])[:size]
            return rare[:size]
        return s[:size]


def sketch(s: np.ndarray, bits: int | None = None) -> bytes:
    """Parities of the set's hashes modulo a power of two, a fingerprint: sets differ in as many shingles at least as these in bits."""
    bits = bits or max(64, 1 << len(s).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(a: bytes, size: int) -> np.ndarray:
    """The fingerprint of `size` bytes of the same set: halves add up."""
    x = np.frombuffer(a, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(a: bytes, n: int, b: bytes, m: int, least: tuple[int, int]) -> bool:
    """Whether sets of n and m shingles with these fingerprints can be of similarity `least`."""
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return differ * (least[1] + least[0]) <= (n + m) * (least[1] - least[0])


def alike(n: np.ndarray, m: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether sets of n and m shingles can be of similarity `least`."""
    return np.minimum(n, m) * least[1] >= np.maximum(n, m) * least[0]


def columns(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)


def as_pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """(u, v), u < v, once each."""
    found = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])


def met(least: tuple[int, int]) -> Callable:
    """Those rows (token, n, node), sorted, that have another of their token and of a size that can be alike. Holds a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = np.zeros((0, 3), np.int64), False  # the last row, which waits for its next, and whether it is known to stay
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([held, columns(b)])
            near = (rows[1:, 0] == rows[:-1, 0]) & alike(rows[1:, 1], rows[:-1, 1], least)
            stay = np.r_[near, False] | np.r_[first, near]
            out = rows[:-1][stay[:-1]]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(3)], ["token", "n", "node"])
            held, first = rows[-1:], bool(stay[-1])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(3)], ["token", "n", "node"])

    return run


def stars(least: tuple[int, int]) -> Callable:
    """Pairs of each row (token, n, node, label), sorted by token, with the first one of its token. Holds a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = columns(b)
            if lead is not None:
                rows = np.concatenate([lead, rows])
            new = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
            leads = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
            ok = (rows[:, 3] != leads[:, 3]) & alike(rows[:, 1], leads[:, 1], least)
            yield as_pairs(rows[ok, 2], leads[ok, 2])
            lead = leads[-1:]

    return run


def runs(f: Callable[[np.ndarray, list], Iterator[pa.RecordBatch]], key: int, numbers: int) -> Callable:
    """A map over rows sorted by their first `key` columns: `f` gets whole runs of these, some 20,000 rows at once, as numbers and the column after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, more = np.zeros((0, numbers), np.int64), []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([rows, columns(b.select(range(numbers)))])
            more += b.column(numbers).to_pylist() if b.num_columns > numbers else []
            if len(rows) >= 20_000:
                last = int(np.flatnonzero(np.r_[True, (rows[1:, :key] != rows[:-1, :key]).any(1)])[-1])
                if last:
                    yield from f(rows[:last], more[:last])
                    rows, more = rows[last:], more[last:]
        if len(rows):
            yield from f(rows, more)

    return run


def of_small(least: tuple[int, int]) -> Callable:
    """All pairs of rows (token, n, node, label) of one token and other labels; a token has SMALL rows at most."""

    def f(rows: np.ndarray, _: list) -> Iterator[pa.RecordBatch]:
        for o in range(1, min(SMALL, len(rows))):
            a, b = rows[:-o], rows[o:]
            ok = (a[:, 0] == b[:, 0]) & (a[:, 3] != b[:, 3]) & alike(a[:, 1], b[:, 1], least)
            if ok.any():
                yield as_pairs(a[ok, 2], b[ok, 2])

    return runs(f, 1, 4)


def pivot_table(x: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to pivots, which are drawn from them, each the farthest from those before."""
    far, out = None, []
    at = 0
    for _ in range(min(most, len(x))):
        d = np.bitwise_count(x ^ x[at]).sum(1, dtype=np.int64)
        out.append(d)
        far = d if far is None else np.minimum(far, d)
        at = int(far.argmax())
    return np.stack(out, axis=1)


def near_pairs(own: np.ndarray, x: np.ndarray, least: tuple[int, int], label: np.ndarray, coarse: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, distance) of rows (side, n, ...) of other labels whose fingerprints x can be linked, 64 rows with all after them at a time: of
    both sides, or all if there is one; none of two `coarse` rows. `label` may change meanwhile."""
    side, n = own[:, 0], own[:, 1]
    table = pivot_table(x)
    total, gap = least[0] + least[1], least[1] - least[0]
    one = side.min() == side.max()
    step = max(1, (1 << 24) // (8 * x.shape[1]))
    for at in range(0, len(own), 64):
        mine = slice(at, at + 64)
        near = (label[mine, None] != label) & (np.arange(len(own)) > np.arange(len(own))[mine, None]) & alike(n[mine, None], n, least)
        if coarse is not None:
            near &= ~(coarse[mine, None] & coarse)
        i, j = np.nonzero(near if one else near & (side[mine, None] != side))
        i += at
        room = (n[i] + n[j]) * gap
        for c in range(table.shape[1]):  # |d(x, p) - d(y, p)| <= d(x, y) for every pivot p
            ok = np.abs(table[i, c] - table[j, c]) * total <= room
            i, j, room = i[ok], j[ok], room[ok]
        if len(i):
            d = np.concatenate([np.bitwise_count(x[i[k : k + step]] ^ x[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)])
            ok = d * total <= room
            yield i[ok], j[ok], d[ok]


def of_large(least: tuple[int, int]) -> Callable:
    """Edges that connect what can be linked among rows (token, block, side, n, node, label, sketch) of one token and block. A block gives
    fewer edges than it has rows, however many of its pairs can be linked; an edge joins a cluster and need not be such a pair.
    Fingerprints are compared at the size of the smaller set's, for a short one says nothing of a long text."""
    wider = 1 << (-(-least[1] // least[0]) - 1).bit_length()  # sets that can be alike have fingerprints of sizes that differ by this factor at most

    def block(own: np.ndarray, sketches: list[bytes]) -> pa.RecordBatch | None:
        size, low = np.array([len(s) for s in sketches]), np.arange(len(own))
        for c in np.unique(size).tolist():
            at = np.flatnonzero((size >= c) & (size <= c * wider))
            if len(at) < 2:
                continue
            x = np.stack([folded(sketches[i], c) for i in at]).view(np.uint64)
            for i, j, _ in near_pairs(own[at, 2:4], x, least, own[at, 5], size[at] > c):
                i, j = at[i], at[j]
                if len(i := i[apart := low[i] != low[j]]):
                    new = np.flatnonzero(low != np.arange(len(own)))
                    low = lowest(len(own), np.r_[new, i], np.r_[low[new], j[apart]])
        new = np.flatnonzero(low != np.arange(len(own)))
        return as_pairs(own[new, 4], own[low[new], 4]) if len(new) else None

    def f(rows: np.ndarray, sketches: list) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        for a, b in zip(first, np.r_[first[1:], len(rows)], strict=True):
            if (out := block(rows[a:b], sketches[a:b])) is not None:
                yield out

    return runs(f, 2, 6)


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the pairs (i, j) reach from it."""
    low = np.arange(n)
    while True:
        least, before = np.minimum(low[i], low[j]), low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return low


def linked_in(own: np.ndarray, sets: list[np.ndarray], least: tuple[int, int]) -> pa.RecordBatch | None:
    """Links (u, v) among rows (side, n, node, label) with these sets that connect what is linked there, verified: fewer than there are rows.
    A pair that is connected already, by labels or by links found, isn't compared."""
    bits = min(8_192, max(512, 1 << int(own[:, 1].max()).bit_length()))
    x = np.frombuffer(b"".join(sketch(s, bits) for s in sets), np.uint64).reshape(len(sets), -1)
    label = own[:, 3].copy()
    found = []
    for i, j, d in near_pairs(own, x, least, label):
        for k in np.argsort(d, kind="stable"):  # the likeliest first
            a, b = int(i[k]), int(j[k])
            if label[a] != label[b]:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both * least[1] >= (len(sets[a]) + len(sets[b]) - both) * least[0]:
                    found.append((a, b))
                    label[label == label[b]] = label[a]
    if found:
        u, v = own[np.array(found), 2].T
        return as_pairs(u, v)
    return None


def of_cluster(least: tuple[int, int]) -> Callable:
    """Links among rows (cluster, block, side, n, node, label, set), sorted by cluster and block, of one cluster and block. Holds a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = np.zeros((0, 6), np.int64), []
        for b in (*batches, None):
            if b is not None:
                held = np.concatenate([held, columns(b.select(range(6)))])
                more += [np.frombuffer(s, np.uint64) for s in b.column(6).to_pylist()]
            first = np.flatnonzero(np.r_[True, (held[1:, :2] != held[:-1, :2]).any(1)]) if len(held) else np.zeros(0, np.int64)
            ends = [*first[1:].tolist(), *([len(held)] if b is None and len(held) else [])]
            for at, end in zip(first.tolist(), ends, strict=False):
                if (out := linked_in(held[at:end, 2:], more[at:end], least)) is not None:
                    yield out
            if ends:
                held, more = held[ends[-1] :], more[ends[-1] :]

    return run


def clustered(pairs: DataFrame, large: DataFrame, texts: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """Links that connect what is linked among the nodes of `large` (node, label) that the edges `pairs` (u, v) connect to clusters.

    The texts' sets go to their cluster, once; a cluster of over WIDE rows or HEAVY shingles is dealt to blocks of that size in pairs, so no task
    holds more than two blocks and none gives more links than it has rows.
    """
    cluster = cut(components(pairs).select("node", F.col("component").alias("cluster")))
    own = cut(join_checked(cluster, large.select("node", "label").distinct(), ["node"], "inner"))
    some = join_checked(texts, own, ["node"], "inner").dropDuplicates(["node"])

    def batch(cols):
        sets = shingle_sets(cols["text"], k)
        yield {"n": [len(s) for s in sets], "set": [s.tobytes() for s in sets]}

    rows = map_arrow(some, batch, "n bigint, set binary", text="text", carry=("cluster", "node", "label"))
    rows = cut(rows.withColumnsRenamed({"carried_0": "cluster", "carried_1": "node", "carried_2": "label"}))
    sizes = rows.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / WIDE), F.ceil(F.sum("n") / HEAVY)).cast("bigint").alias("parts"))
    rows = dealt(join_checked(rows, sizes, ["cluster"], "inner"), "cluster", "set")
    return rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(of_cluster(least), "u bigint, v bigint")


def dealt(rows: DataFrame, key: str, last: str) -> DataFrame:
    """`rows` (key, n, node, label, parts, last) for each pair of blocks that is to meet: (key, block, side, n, node, label, last)."""
    mine = F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts"))
    rows = rows.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return rows.select(key, (F.least("side", "other") * F.col("parts") + F.greatest("side", "other")).alias("block"), "side", "n", "node", "label", last)


def common_shingles(texts: DataFrame, n: int, k: int) -> Order:
    """The order by shingles that are in several of a sample of the n texts."""
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(n, 1))) + 1)

    def batch(cols):
        yield {"token": np.concatenate(shingle_sets([t or b"" for t in cols["text"]], k)).view(np.int64)}

    each = map_arrow(some.select("text"), batch, "token bigint", text="text")
    rows = each.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(COMMON).collect()
    token = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    return Order(token[order], np.array([r[1] for r in rows], np.int64)[order])


def both_sides(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) with the other columns of `rows` (node, ...) for both, as u_... and v_...; of `rows` just what is needed travels."""
    needed = cut(found.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    own = join_checked(rows, needed, ["node"], "left_semi", 2_000_000).dropDuplicates(["node"])
    for c in "uv":
        found = found.join(own.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in rows.columns if x != "node"]), c)
    return found


def possible(found: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of the pairs (u, v) whose fingerprints can be linked; `sets` has (node, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_link(*x, least) for x in zip(*(b.column(c).to_pylist() for c in ("u_sketch", "u_n", "v_sketch", "v_n")), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both_sides(found, sets.select("node", "n", "sketch")).mapInArrow(run, "u bigint, v bigint")


def verified(found: DataFrame, texts: DataFrame, k: int, least: tuple[int, int]) -> DataFrame:
    """Those of the pairs (u, v) whose texts' shingles have the similarity; `texts` has (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            u, v = (b.column(c).to_pylist() for c in "uv")
            texts = dict(zip([*u, *v], [*b.column("u_text").to_pylist(), *b.column("v_text").to_pylist()], strict=True))
            sets = dict(zip(texts, shingle_sets([*texts.values()], k), strict=True))
            for x, y in zip(u, v, strict=True):
                a, c = sets[x], sets[y]
                both = len(np.intersect1d(a, c, assume_unique=True))
                ok.append(both * least[1] >= (len(a) + len(c) - both) * least[0])
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both_sides(found, texts).mapInArrow(run, "u bigint, v bigint")


def links(sets: DataFrame, texts: DataFrame, k: int, least: tuple[int, int], rounds: int = ROUNDS, first: DataFrame | None = None) -> DataFrame | None:
    """Edges (u, v) whose components are those of all pairs of `sets` (node, n, prefix, sketch) with the similarity; None if there is none.

    Pairs (u, v) in `first` are tried in the first round, whatever their prefixes.
    Members of a large group meet by stars first, so what they have in common is not expanded to pairs; those that are
    not connected after that all meet. Pairs of small buckets are verified as rows; large buckets only tell which rows can be
    linked at all, as clusters, and within these the sets are compared where they meet: what is not a link makes no row there. No
    task holds more than a pair of blocks of a bucket or cluster.
    """
    postings = sets.select(F.explode("prefix").alias("token"), "n", "node")
    held = cut(postings.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(met(least), "token bigint, n bigint, node bigint"))
    if held.isEmpty():
        return None
    edges = tried = sure = None
    label = held.withColumn("label", F.col("node"))
    for turn in range(rounds + 1):
        if turn < rounds:
            met_first = label.repartition("token").sortWithinPartitions("token", F.xxhash64("node", F.lit(turn)))
            found = met_first.mapInArrow(stars(least), "u bigint, v bigint")
        else:
            whole = Window.partitionBy("token")
            many = label.withColumn("rows", F.count("*").over(whole)).withColumn("low", F.min("label").over(whole)).withColumn("high", F.max("label").over(whole))
            many = cut(many.where("low < high").select("token", "n", "node", "label", "rows"))
            few = many.where(F.col("rows") <= SMALL).select("token", "n", "node", "label")
            found = few.repartition("token").sortWithinPartitions("token").mapInArrow(of_small(least), "u bigint, v bigint")
            large = many.where(F.col("rows") > SMALL)
            if not large.isEmpty():
                blocks = join_checked(large, sets.select("node", "sketch"), ["node"], "inner")
                blocks = dealt(blocks.withColumn("parts", F.ceil(F.col("rows") / BLOCK).cast("bigint")), "token", "sketch")
                pairs = cut(blocks.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(of_large(least), "u bigint, v bigint"))
                if not pairs.isEmpty():
                    sure = cut(clustered(pairs, large, texts, k, least))
        found = (found.union(first) if first is not None and turn == 0 else found).distinct()
        found = cut(possible(cut(found if tried is None else found.join(tried, ["u", "v"], "left_anti")), sets, least))
        if not found.isEmpty():
            new = cut(verified(found, texts, k, least))
            tried = found if tried is None else tried.union(found)
            edges = new if edges is None else edges.union(new)
            if turn < rounds and not new.isEmpty():
                comp = components(edges).withColumnRenamed("component", "label")
                label = join_checked(held, cut(comp), ["node"], "left").select("token", "n", "node", F.coalesce("label", "node").alias("label"))
    if sure is not None:
        edges = sure if edges is None else edges.union(sure)
    return None if edges is None or edges.isEmpty() else edges


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, least: tuple[int, int] = LEAST, rounds: int = ROUNDS, fingerprint: Callable[[bytes, int], int] | None = None, candidates: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per row of `df`: id, component_id (smallest id reachable by links, itself included).

    Texts link where the Jaccard similarity of their sets of k-word shingles (words are what white space parts, ASCII
    capitals as small letters) is `least` or more. Shingles are 64-bit hashes; apart from chance collisions of these
    no link is lost and none is added. Equal texts are one node; null, empty and wordless texts have the empty set and
    link to each other alone, a text of fewer than k words is one shingle. Repeated rows are answered again; a null id is larger than any;
    an empty table gives no rows; other columns are ignored.

    `fingerprint` of a text and k is a 64-bit number; of (node, fp), one row per text with a word, `candidates` makes the
    pairs (u, v) that are verified first. They save work and change no result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    node = F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.lit(0).cast("bigint"))
    texts = df.select(F.col(id_col).alias("id"), node.alias("node"), text.cast("binary").alias("text"))
    docs = texts.select("id", "node")
    lows = cut(docs.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("rows")))
    order = common_shingles(texts, lows.count(), k)

    def batch(cols):
        sets = shingle_sets(cols["text"], k)
        yield {"n": [len(s) for s in sets], "prefix": [order.prefix(s, least).view(np.int64) for s in sets], "sketch": [sketch(s) for s in sets], "fp": np.array([fingerprint(t, k) if fingerprint else 0 for t in cols["text"]], np.uint64).view(np.int64)}

    read = map_arrow(texts.select("node", "text"), batch, "n bigint, prefix array<bigint>, sketch binary, fp bigint", text="text", carry=("node",))
    read = cut(read.withColumnRenamed("carried_0", "node").withColumn("row", F.monotonically_increasing_id()))
    twice = join_checked(read.select("node", "row"), lows.where("rows > 1").select("node"), ["node"], "left_semi").groupBy("node").agg(F.min("row").alias("first"))
    sets = join_checked(read, cut(twice), ["node"], "left").where("first is null or row = first")
    first = candidates(sets.where("n > 0").select("node", "fp")) if candidates else None
    edges = links(sets, texts.select("node", "text"), k, least, rounds, first)
    if edges is None:
        label = lows.where("rows > 1").select("node", F.col("low").alias("least"))
    else:
        members = cut(lows.join(components(edges), "node", "left").where("rows > 1 or component is not null"))
        least_of = members.where("component is not null").groupBy("component").agg(F.min("low").alias("least"))
        label = join_checked(members, least_of, ["component"], "left").select("node", F.coalesce("least", "low").alias("least"))
    out = join_checked(docs, cut(label), ["node"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("least", "id").alias("component_id"))
