"""What the operators of this folder share: reading tables, cutting lineage, Arrow row maps, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may have to be broadcast; its rows are a few dozen bytes, so this is some tens of MB at most.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Where it is unset, a temporary folder in local mode; on a cluster an error, for no local folder would be shared."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lectern-"))
    return spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder that all executors share, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`left` joined with `right`: by broadcast if `right` is proven small, otherwise shuffled, where AQE splits hot keys."""
    return left.join(F.broadcast(right) if small(right, rows) else right, on, how)


#: Rows of an Arrow batch at most. Texts can be long, and each task holds some batches at a time, in and out.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, batch: Callable[[dict[str, list]], Iterable[dict[str, list]]], schema: str, chars: int = 4_000_000, text: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Runs `batch` over column dicts of `df`, in slices of about `chars` characters of column `text`, and returns what it yields.

    `batch` gets and yields {column: list or array}; a slice has one row at least, so a very long text comes alone.
    Columns named in `carry` aren't shown to `batch`, which must then yield once, a row for each of its rows; they
    come first in the result, untouched, as carried_0, carried_1, ...
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    small_batches(df.sparkSession)
    target = StructType([*[StructField(f"carried_{i}", df.schema[c].dataType) for i, c in enumerate(carry)], *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(target)
    fields = list(arrow)[len(carry) :]
    df = df.select(*[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)], *[c for c in df.columns if c not in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text, chars):
                kept = [part.column(i) for i in range(len(carry))]
                for out in batch({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names) if i >= len(carry)}):
                    yield pa.RecordBatch.from_arrays([*[k.cast(f.type) for k, f in zip(kept, arrow, strict=False)], *[pa.array(out[f.name], type=f.type) for f in fields]], schema=arrow)

    return df.mapInArrow(run, target)


def slices(b: pa.RecordBatch, text: str | None, chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of `b` with about `chars` bytes of column `text` each."""
    if text is None or b.num_rows == 0:
        if b.num_rows:
            yield b
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(b.column(b.schema.names.index(text))), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > chars:
            yield b.slice(start, i - start)
            start, total = i, 0
        total += n
    yield b.slice(start)


def _fingerprint(edges: DataFrame) -> tuple:
    """The number of edges and two sums of 64-bit hashes: sets of edges that differ have others, but for a chance of about 2 ** -128."""
    h = [F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    return tuple(edges.agg(F.count("*"), *h).first())


#: Edges for which a task is worth starting; of fewer, partitions are mostly the cost of a task and its files.
EDGES_A_TASK = 50_000


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component) for each node of the undirected `edges` (u, v: long); component is its smallest reachable node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes: each step keeps the
    components, points nodes at ever smaller neighbours, and never has more edges than it was given. A node's edges
    meet only in minima, which combine before the shuffle. A step reads the edges in as many tasks as their number
    calls for; in one, nothing is shuffled. Raises if `most` rounds don't suffice (they are about the logarithm of the
    longest path).
    """
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    rows_of = lambda df, *pairs: df.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v")
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(e)
    for _ in range(most):
        e = e.coalesce(1 + seen[0] // EDGES_A_TASK)
        both = rows_of(e, pair("u", "v"), pair("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        e = cut(rows_of(step, pair("v", "m"), pair("u", "m")).where("u <> v").distinct())
        before, seen = seen, _fingerprint(e)
        if seen == before:
            e = e.coalesce(1 + seen[0] // EDGES_A_TASK)
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
    raise RuntimeError(f"components did not settle in {most} rounds")
