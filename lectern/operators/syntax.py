"""Syntax of parsed sentences: tokens to metrics, and sentences to tokens by a parser or by known parses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lectern.functions import lexical, trees
from lectern.sources.conllu import TOKENS

PARSE = f"struct<status:string,tokens:{TOKENS},pieces:int,max:int,error:string>"
SYNTAX = (
    "struct<tree_error:string,distance:bigint,dependencies:bigint,depth:int,clauses:int,"
    "center_embeddings:array<struct<subject:string,verb:string,words_between:int>>,passives:array<struct<verb:string,at:int>>,"
    "content:array<struct<cid:int,chead:int,form:string,deprel:string>>>"
)


def with_known_parses(sentences: DataFrame, parses: DataFrame) -> DataFrame:
    """`sentences` with a column `parse`, by the sentence's text; a sentence without one is `unparsed`.

    parses: (sentence, tokens) or (sentence, parse), one row for each text.
    """
    if "parse" not in parses.columns:
        parses = parses.select("sentence", F.struct(F.lit("parsed").alias("status"), F.col("tokens").cast(TOKENS).alias("tokens"), F.lit(None).cast("int").alias("pieces"), F.lit(None).cast("int").alias("max"), F.lit(None).cast("string").alias("error")).alias("parse"))
    none = F.from_json(F.lit('{"status":"unparsed"}'), PARSE)
    return sentences.join(parses.select("sentence", "parse"), "sentence", "left").withColumn("parse", F.coalesce(F.col("parse").cast(PARSE), none))


def map_column(df: DataFrame, result: str, kind: str, one: Callable[[tuple], object], args: tuple[str, ...]) -> DataFrame:
    """`df` with `result` made by `one` of the values of `args`, in an Arrow map; other columns pass untouched."""
    target = StructType([*[StructField(f.name, f.dataType) for f in df.schema if f.name != result], *StructType.fromDDL(f"{result} {kind}")])
    arrow = to_arrow_schema(target)
    places = [df.columns.index(a) for a in args]
    kept = [i for i, c in enumerate(df.columns) if c != result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                made = [one(*x) for x in zip(*[part.column(i).to_pylist() for i in places], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(arrow.field(k).type) for k, i in enumerate(kept)], pa.array(made, arrow.field(len(kept)).type)], schema=arrow)

    return df.mapInArrow(run, target)


def with_parser(sentences: DataFrame, factory: Callable[[], object]) -> DataFrame:
    """`sentences` with a column `parse`, by the parser that `factory` gives in each worker (`parse(text)` gives a dict
    with status and tokens). An error is kept with its sentence, as status `error`."""

    def one(sentence):
        if sentence is None:
            return {"status": "unparsed", "tokens": None, "pieces": None, "max": None, "error": None}
        try:
            return {"pieces": None, "max": None, "error": None, **factory().parse(sentence)}
        except ValueError as e:
            return {"status": "error", "tokens": None, "pieces": None, "max": None, "error": str(e)}

    return map_column(sentences, "parse", PARSE, one, ("sentence",))


#: Each field of SYNTAX but the error, from the tokens, their projection on content, and the sentence.
_MADE = {
    "distance": lambda tokens, tree, sentence: trees.dependency_distance(tree)[0],
    "dependencies": lambda tokens, tree, sentence: trees.dependency_distance(tree)[1],
    "depth": lambda tokens, tree, sentence: max(trees.depths(tree), default=0),
    "clauses": lambda tokens, tree, sentence: sum(trees.is_clausal(t["deprel"]) for t in tree),
    "center_embeddings": lambda tokens, tree, sentence: trees.center_embeddings(tokens, tree),
    "passives": lambda tokens, tree, sentence: trees.passives(tokens, sentence),
    "content": lambda tokens, tree, sentence: [{k: t[k] for k in ("cid", "chead", "form", "deprel")} for t in tree],
}


def with_syntax(parsed: DataFrame, fields: tuple[str, ...] = tuple(_MADE)) -> DataFrame:
    """`parsed` (sentence, parse) with a column `syntax`; null without tokens. A malformed tree has only its error. Of the
    struct, the `fields` asked for are made and the others null."""

    def one(tokens, sentence):
        if tokens is None:
            return None
        out = {"tree_error": trees.tree_error(tokens), **dict.fromkeys(_MADE)}
        if not out["tree_error"]:
            tree = trees.content(tokens)
            out |= {f: _MADE[f](tokens, tree, sentence) for f in fields}
        return out

    return map_column(parsed.withColumn("_tokens", F.col("parse.tokens")), "syntax", SYNTAX, one, ("_tokens", "sentence")).drop("_tokens")


def with_heads(df: DataFrame, scores: str = "scores", single_root: bool = False) -> DataFrame:
    """`df` with `heads` array<int>: the maximum spanning forest (or tree with one root) of a matrix array<array<double>>
    of scores[head][dependent], roots on its diagonal; a root heads itself. Of equally good forests, the one whose heads come
    first. Null where the matrix or a score is null."""
    import numpy as np

    from lectern.functions.decoding import first_forest, one_root

    def one(matrix):
        if not matrix:
            return matrix
        if any(x is None for row in matrix for x in row):
            return None
        score = np.array(matrix, np.float64)
        return (one_root(score, first_forest) if single_root else first_forest(score)).tolist()

    return map_column(df, "heads", "array<int>", one, (scores,))


def nominalizations(tokens: Column) -> Column:
    """How many nouns of a parse are nominalizations, by the parser's lemma."""
    noun = lambda t: (t.upostag == "NOUN") & lexical.is_nominalization(lexical.parsed_lemma(t.form, t.lemma))
    return F.size(F.filter(tokens, noun)).cast("bigint")


def passive_heads(tokens: Column) -> Column:
    """array<int>: ids of the tokens that head a passive auxiliary, ascending, once each."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: (t.deprel == "aux:pass") & (t.head != 0)), lambda t: t.head)))


def is_clausal(deprel: Column) -> Column:
    return F.split_part(deprel, F.lit(":"), F.lit(1)).isin(*trees.CLAUSAL)


def clause_count(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: (t.upostag != "PUNCT") & is_clausal(t.deprel)))
