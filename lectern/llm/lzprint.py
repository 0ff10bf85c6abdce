"""Document fingerprints: minimum hashes of the phrase set of a Lempel-Ziv parse."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lectern.llm.common import map_arrow, small_batches, table

#: Least hashes that a fingerprint keeps; of fewer phrases it keeps all, and then the likeness is exact.
KEPT = 128
_MASK = (1 << 44) - 1
#: Blocks of neighbouring documents for each partition, of which there is one for so many bytes of text, and blocks at most.
BLOCKS, PART, MOST = 8, 64 << 20, 100_000


class Parse:
    """An LZ78 parse that can be continued, also in two ways.

    A phrase is the longest known phrase plus one byte. Phrases are the nodes of a tree: `tree` leads from
    (node, byte) to a node, and `hashes` has each node's polynomial hash over its phrase's bytes.
    """

    def __init__(self):
        self.tree: dict[int, int] = {}
        self.hashes = [0]
        self.node = 0

    def copy(self) -> "Parse":
        other = Parse()
        other.tree, other.hashes, other.node = self.tree.copy(), self.hashes.copy(), self.node
        return other

    def feed(self, data: bytes) -> "Parse":
        tree, hashes, node, new = self.tree, self.hashes, self.node, len(self.hashes)
        add = hashes.append
        for c in data:
            key = node << 8 | c
            if key in tree:
                node = tree[key]
            else:
                tree[key] = new
                new += 1
                add((hashes[node] * 1000003 + c + 1) & _MASK)
                node = 0
        self.node = node
        return self

    def signature(self) -> np.ndarray:
        """The `KEPT` least of the phrases' mixed hashes, in order."""
        h = np.array(self.hashes[1:], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = np.unique((h >> np.uint64(32)).astype(np.uint32))
        return h[:KEPT]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets: the share of the least hashes of both that both have. Two empty ones: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    either = np.union1d(a, b)[:KEPT]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, either[-1], "right") / len(either))


def written(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprint(text: str | None) -> str:
    return written(Parse().feed((text or "").encode()).signature())


def lz_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row: hex of at most KEPT 32-bit hashes; '' for null and empty texts. Equal texts have
    equal fingerprints; texts are parsed whole; repeated rows are answered again; other columns are ignored."""

    def batch(cols):
        yield {"id": cols["id"], "fingerprint": [fingerprint(t) for t in cols["text"]]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), batch, f"id {kind}, fingerprint string", text="text").withColumnRenamed("id", id_col)


def ordered(df: DataFrame, id_col: str) -> tuple[F.Column, F.Column]:
    """(the id as a key that is never null and orders like it, nulls first, the key as the id again). Ids that aren't integers
    are ordered as strings."""
    kind = df.schema[id_col].dataType
    if isinstance(kind, IntegralType):
        return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))), F.when(F.col("id") > -(2**63), F.col("id")).cast(kind)
    return F.coalesce(F.concat(F.lit("1"), F.col(id_col).cast("string")), F.lit("0")), F.when(F.col("id") != "0", F.expr("substring(id, 2)")).cast(kind)


def neighbour_blocks(df: DataFrame, key: F.Column, text_col: str) -> DataFrame:
    """(block, tail, id, text) sorted within each block: a block's documents in order of id, and after them, with tail 1,
    the document that follows the last (for the last block: the first of all).

    Blocks are ranges between quantiles of the ids, a number that grows with the bytes of the texts; the driver holds one
    id for each. Whole texts travel once, for three quarters of each meet a quarter of the next; only a block's first row travels
    twice. Of rows with one id, the order is that of their texts.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(key.alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("id").alias("low")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.bytes or 0) // PART))
    n = min(MOST, BLOCKS * parts)
    if rows.schema["id"].dataType.simpleString() == "bigint":
        found = rows.agg(F.percentile_approx("id", [i / n for i in range(n)], F.lit(100 * n)).alias("q")).first().q or []
    else:
        some = sorted(r.id for r in rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(10 * n).collect())
        found = [some[len(some) * i // n] for i in range(n)] if some else []
    lows = np.array(sorted({*found, size.low} - {None}), object if found and isinstance(found[0], str) else np.int64)

    @F.pandas_udf("bigint")
    def code(ids: pd.Series) -> pd.Series:
        own = ids.to_numpy(lows.dtype)
        at = np.searchsorted(lows, own, "right") - 1
        return pd.Series(at * 2 + (lows[at] == own))

    block = F.shiftright("code", 1)
    own = F.struct(block.alias("block"), F.lit(0).alias("tail"))
    before = F.struct(F.when(block > 0, block - 1).otherwise(F.lit(len(lows) - 1).cast("bigint")).alias("block"), F.lit(1).alias("tail"))
    dealt = rows.withColumn("code", code("id")).select(F.explode(F.when(F.col("code") % 2 == 1, F.array(own, before)).otherwise(F.array(own))).alias("b"), "id", "text")
    return dealt.select("b.block", "b.tail", "id", "text").repartition(parts, "block").sortWithinPartitions("block", "tail", "id", "text")


def edit(text: str, following: str) -> tuple[int, str]:
    """(code points that stay, code points that come) of the edited text: its last quarter gives way to the start of the following one."""
    q = len(text) // 4
    return len(text) - q, following[:q]


def neighbour_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n/4) code points replaced by as many of the next document's
    first (or all that it has), by ascending id, after the last the first. A text is parsed once: the edited text's
    parse branches off where the edit begins. Null counts as empty; rows that repeat an id follow each other in
    order of text; an only document follows itself; an empty table gives no rows; a null id comes first; ids keep their
    type, and are ordered as strings where they aren't integers.
    """
    key, back = ordered(df, id_col)
    kind = "bigint" if isinstance(df.schema[id_col].dataType, IntegralType) else "string"
    schema = pa.schema([("id", pa.int64() if kind == "bigint" else pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (block, id, text, kept, parse before the edit, signature) of the row that waits for its next
        out: list[tuple] = []

        def answer(row, text, signature):
            _, i, own, _, branch, mine = row
            kept, come = edit(own, text)
            edited = own[:kept] + come
            theirs = branch.feed(come.encode()).signature()
            return i, len(own), hashlib.sha256(edited.encode()).hexdigest(), written(mine), written(theirs), likeness(mine, theirs), likeness(mine, signature)

        for b in batches:
            for block, tail, i, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                text = text or ""
                if tail and (last is None or last[0] != block):
                    continue
                kept, _ = edit(text, "")
                before = Parse().feed(text[:kept].encode())
                branch = before.copy()
                signature = before.feed(text[kept:].encode()).signature()
                if last is not None and last[0] == block:
                    out.append(answer(last, text, signature))
                last = None if tail else (block, i, text, kept, branch, signature)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    done = neighbour_blocks(df, key, text_col).mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumn("id", back).withColumnRenamed("id", id_col)


def lzprint_query(spark, sf_dir: str) -> DataFrame:
    return neighbour_likeness(table(spark, sf_dir, "documents"))
