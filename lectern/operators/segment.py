"""Documents in Markdown or plain text to blocks and sentences with their places in the source.

One Arrow map does all that needs a document's text; what follows is exploding and JVM expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lectern.functions import words
from lectern.functions.segmentation import segment as segment_one

SENTENCE = "struct<text:string,block_start:int,start:int,end:int,line:int,column:int,end_line:int,end_column:int>"
BLOCK = f"struct<text:string,pieces:array<struct<block_start:int,source_start:int>>,spans:array<struct<text:string,start:int,end:int,joins_previous:boolean>>,sentences:array<{SENTENCE}>>"


def segment(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, prose_spans, blocks) for each document (keys, source, format). Offsets are bytes; lines and columns count
    from 1, columns in characters. A null source is empty."""
    target = StructType([*[docs.schema[k] for k in keys], *StructType.fromDDL(f"prose_spans bigint, blocks array<{BLOCK}>")])
    target = StructType([StructField(f.name, f.dataType) for f in target])
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                kept = [part.column(i).cast(f.type) for i, f in zip(range(len(keys)), arrow, strict=False)]
                done = [segment_one(s or "", f) for s, f in zip(part.column(len(keys)).to_pylist(), part.column(len(keys) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([d["prose_spans"] for d in done], pa.int64()), pa.array([d["blocks"] for d in done], arrow.field("blocks").type)], schema=arrow)

    return docs.select(*keys, "source", "format").mapInArrow(run, target)


def block_rows(segmented: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, block_ix, block)."""
    return segmented.select(*keys, F.posexplode("blocks").alias("block_ix", "block"))


def span_rows(segmented: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, block_ix, span_ix, text, start, end, joins_previous)."""
    return block_rows(segmented, keys).select(*keys, "block_ix", F.posexplode("block.spans").alias("span_ix", "s")).select(*keys, "block_ix", "span_ix", "s.*")


def sentence_rows(segmented: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, sent_ix, sentence, block_start, start, end, line, column, end_line, end_column, pieces), in source order."""
    return _sentences(segmented, keys, F.posexplode)


def sentence_rows_and_empty(segmented: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same with the document's `prose_spans` and `block_words` on each row, and a row with a null sentence for a
    document that has none: what file totals need, in one pass over the documents."""
    block_words = F.aggregate(F.transform("blocks", lambda b: F.size(words.words(b.text))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _sentences(segmented.withColumn("block_words", block_words), (*keys, "prose_spans", "block_words"), F.posexplode_outer)


def _sentences(segmented: DataFrame, keys: tuple[str, ...], explode) -> DataFrame:
    every = F.flatten(F.transform("blocks", lambda b: F.transform(b.sentences, lambda s: F.struct(s.alias("s"), b.pieces.alias("pieces")))))
    rows = segmented.select(*keys, explode(every).alias("sent_ix", "x"))
    return rows.select(*keys, "sent_ix", F.col("x.s.text").alias("sentence"), *[f"x.s.{c}" for c in ("block_start", "start", "end", "line", "column", "end_line", "end_column")], "x.pieces")


def source_offset(pieces: Column, block_offset: Column) -> Column:
    """A place in a block as a place in the source: the last piece that begins at or before it, and the rest."""
    piece = F.element_at(F.filter(pieces, lambda p: p.block_start <= block_offset), -1)
    return piece.source_start + block_offset - piece.block_start


def line_column(source: Column, offset: Column) -> Column:
    """struct<line, column> of a byte offset; null beyond the end or inside a character."""
    head = F.substring(F.encode(source, "UTF-8"), F.lit(1), offset)
    text = F.try_validate_utf8(head.cast("string"))
    tail = F.substring_index(text, "\n", -1)
    ok = (offset >= 0) & (offset <= F.octet_length(source)) & text.isNotNull()
    return F.when(ok, F.struct((F.regexp_count(text, F.lit("\n")) + 1).alias("line"), (F.length(tail) + 1).alias("column")))
