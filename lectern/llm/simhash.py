"""SimHash near-dedup: fingerprints of word shingles, linked by way of pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import components, cut, join_checked, map_arrow, table
from lectern.llm.shingles import near_copies

SEED = 42
#: A bucket of more fingerprints than this is split by two blocks of its other bits. Of LINK + 2 = 4 blocks, that leaves
#: 48 bits alike, so no bucket has over 65,536.
BUCKET = 1_000
PIVOTS = 32
LINK = 2
#: Candidates for a similarity: any two fingerprints within SURE bits meet, and those that meet count up to NEAR bits.
SURE, NEAR = 4, 12


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit numbers."""
    return np.random.default_rng(7).integers(0, 2**64, n, dtype=np.uint64)


def fingerprint(text: bytes, k: int = 3) -> int:
    """The SimHash of the text's k-word shingles; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - k + 1].tolist()
    digest, stop = xxhash.xxh64_intdigest, end[k - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(start)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at : at + (1 << 16)], stop[at : at + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp) for each row: the fingerprint as a signed long."""

    def batch(cols):
        fps = np.array([fingerprint(t or b"", k) for t in cols["text"]], np.uint64)
        yield {"id": cols["id"], "fp": fps.view(np.int64)}

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), batch, f"id {kind}, fp bigint", text="text")


def linked(fp: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, most: int = LINK) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that differ in `most` bits or fewer.

    |d(x, p) - d(y, p)| <= d(x, y) for every pivot p, so a pair whose distance tables differ by more in any
    coordinate is discarded; survivors are verified on the fingerprints.
    """
    for at in range(0, table.shape[1], 8):
        near = (np.abs(table[i, at : at + 8] - table[j, at : at + 8]) <= most).all(1)
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= most
    return i[near], j[near]


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the links (i, j) reach from it."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            break
    return low


def pairs_in(group: np.ndarray, fp: np.ndarray, reference: np.ndarray, most: int = LINK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (places i, j) within each group that differ in `most` bits or fewer; `group` is sorted."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    own = np.repeat(size, size)
    small = np.flatnonzero(own <= 32)
    for o in range(1, int(min(32, size.max(initial=1)))):
        i = small[small + o < n]
        i = i[group[i] == group[i + o]]
        if len(i):
            yield linked(fp, i, i + o, table, most)
    for a, b in zip(first[size > 32], size[size > 32], strict=True):
        order = a + np.argsort(table[a : a + b, 0], kind="stable")
        key = table[order, 0]
        upper = np.searchsorted(key, key + most, "right")
        for at in range(0, b, 256):
            stop = min(at + 256, b)
            i, j = np.nonzero(np.arange(at, int(upper[stop - 1]))[None, :] > np.arange(at, stop)[:, None])
            near = np.abs(table[order[at + i], 1] - table[order[at + j], 1]) <= most
            yield linked(fp, order[at + i[near]], order[at + j[near]], table, most)


def links_in(group: np.ndarray, fp: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, smallest linked fp's place) that connect what is linked within each group; `group` is sorted."""
    n = len(fp)
    found = [*pairs_in(group, fp, reference)]
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    low = stars(n, i, j)
    out = np.flatnonzero(low != np.arange(n))
    return out, low[out]


def first_in(group: np.ndarray, fp: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place with the first one of its group within NEAR bits; `group` is sorted."""
    first = np.full(len(fp), len(fp))
    for i, j in pairs_in(group, fp, reference, NEAR):
        np.minimum.at(first, i, j)
        np.minimum.at(first, j, i)
    out = np.flatnonzero(first < len(fp))
    return out, first[out]


def bucket_links(find: Callable) -> Callable:
    """(u, v) edges of the last column among rows (key, sub, fp, ...), sorted, of the same (key, sub), by `find`. Holds one bucket at least, 100,000 rows or so at most."""
    reference = pivots()

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, (rows[1:, :2] != rows[:-1, :2]).any(1)])
        fp = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        i, j = find(group, fp, reference)
        return pa.RecordBatch.from_arrays([pa.array(rows[i, -1]), pa.array(rows[j, -1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
            if sum(map(len, held)) >= 50_000:
                rows = np.concatenate(held)
                last = int(np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])[-1])  # where the last bucket, perhaps unfinished, begins
                if last:
                    yield flush(rows[:last])
                held = [rows[last:]]
        if held and len(rows := np.concatenate(held)):
            yield flush(rows)

    return run


def shares(bits: int, parts: int) -> list[tuple[int, int]]:
    """(place, width) of each of `parts` blocks of a number of so many bits."""
    at = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def blocks(value, which: list[tuple[int, int]]):
    """The blocks of `value`, one after the other, as a number."""
    out = F.lit(0).cast("bigint")
    for at, width in which:
        out = F.shiftleft(out, width) + F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    return out


def buckets(unique: DataFrame, bucket: int = BUCKET, sure: int = LINK) -> DataFrame:
    """Rows (key, sub, fp, ...) of `unique` (fp, ...): any two that differ in `sure` bits or fewer share a (key, sub).

    They have two equal ones of sure + 2 blocks, for each block that isn't equal takes a bit (LINK: four of 16 bits, six
    keys each); keys that one fingerprint has go at once.
    """
    fp, whole, pairs = F.col("fp"), shares(64, sure + 2), list(combinations(range(sure + 2), 2))
    keys = [F.lit(t << 32).cast("bigint") + blocks(fp, [whole[i] for i in p]) for t, p in enumerate(pairs)]
    banded = unique.select("*", F.explode(F.array(*keys)).alias("key"))
    full = cut(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = join_checked(banded, full, ["key"], "inner")
    others = [[w for i, w in enumerate(whole) if i not in p] for p in pairs]
    rest = F.element_at(F.array(*[blocks(fp, o) for o in others]), (F.shiftright("key", 32) + 1).cast("int"))
    part = shares(max(sum(width for _, width in o) for o in others), sure + 2)
    finer = F.array(*[F.lit(t << 16).cast("bigint") + blocks(F.col("rest"), [part[i] for i in p]) for t, p in enumerate(pairs)])
    subs = F.when(F.col("n") > bucket, finer).otherwise(F.array(F.lit(-1).cast("bigint")))
    return shared.withColumn("rest", rest).select("key", F.explode(subs).alias("sub"), *unique.columns)


def links(unique: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of `unique.fp` that differ in two bits or fewer."""
    rows = buckets(unique.select("fp"), bucket)
    return rows.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(bucket_links(links_in), "u bigint, v bigint")


def candidates(texts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (u, v) of the nodes of `texts` (node, fp) whose fingerprints are near, to be verified on the texts.

    Nodes of one fingerprint are each paired with one of them, which meets those of other fingerprints in buckets; there
    the pivots' distance tables discard pairs, and each is paired with the first within NEAR bits, so a bucket gives no more
    pairs than it has rows. Who has others within SURE bits is paired at least once.
    """
    unique = cut(texts.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")))
    rows = buckets(unique.select("fp", "node"), bucket, SURE)
    near = rows.repartition("key", "sub").sortWithinPartitions("key", "sub", "node").mapInArrow(bucket_links(first_in), "u bigint, v bigint")
    same = join_checked(texts, unique.where("n > 1").select("fp", F.col("node").alias("low")), ["fp"], "inner").where("node > low")
    pairs = near.union(same.select("low", "node"))
    return cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bucket: int = BUCKET, least: tuple[int, int] | None = None) -> DataFrame:
    """One row per row of `df`: id, fp (signed long), component_id (smallest id reachable by links, itself included).

    With `least`, a similarity as a fraction, texts link by the Jaccard similarity of their k-word shingles and there is no
    fp in the result. The fingerprints give `candidates`, which are verified on the texts; as no radius of them covers a
    similarity of 0.8, `shingles.near_copies` finds what links remain, exactly.

    Fingerprints link at two or fewer differing bits. Equal fingerprints are one node, so copies are never expanded
    to pairs; the links of the rest come from `links`, and a bucket gives at most one edge for each of its members.
    Null, empty and wordless texts have fingerprint 0, which links like any other. Repeated rows are answered again;
    an empty table gives no rows; other columns are ignored.
    """
    if least:
        return near_copies(df, id_col, text_col, k, least, fingerprint=fingerprint, candidates=lambda texts: candidates(texts, bucket))
    docs = cut(fingerprints(df, id_col, text_col, k))
    unique = cut(docs.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    edges = cut(links(unique, bucket))
    if edges.isEmpty():
        label = unique.where("n > 1").select("fp", F.col("low").alias("least"))
    else:
        comp = components(edges).select(F.col("node").alias("fp"), F.col("component").alias("class"))
        members = cut(unique.join(comp, "fp", "left").where("n > 1 or class is not null"))
        lows = members.where("class is not null").groupBy("class").agg(F.min("low").alias("least"))
        label = join_checked(members, lows, ["class"], "left").select("fp", F.coalesce("least", "low").alias("least"))
    out = join_checked(docs, cut(label), ["fp"], "left")
    return out.select(F.col("id").alias(id_col), "fp", F.coalesce("least", "id").alias("component_id"))


def simhash_query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
