"""Reports as columns: what the command line prints for one file, for every document of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import rendering
from lectern.operators.syntax import map_column


def tables(files: DataFrame, path: str = "path") -> DataFrame:
    """`files` (path and the columns of `analysis.file_analysis`) with a column `report`: the metric table."""
    names = ("prose_spans", "block_words", "words", "sentences", "syllables", "complex_words", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "average_sentence_length", "mean_dependency_distance", "mdd_absence", "nominalizations", "nominalization_ratio", "passives")

    def one(p, *values):
        return rendering.table(p, dict(zip(names, values, strict=True)))

    return map_column(files, "report", "string", one, (path, *names))


def annotated(diagnostics: DataFrame, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), path: str = "path") -> DataFrame:
    """Diagnostic rows (with a path) with a column `report`: the annotated source lines.

    A document's diagnostics meet its source as one row, so the source travels once however many there are. Documents are
    told by their keys, which are theirs alone; one without diagnostics gives no row.
    """
    held = [c for c in diagnostics.columns if c not in keys]
    found = diagnostics.groupBy(*keys).agg(F.collect_list(F.struct(*held)).alias("_found"))
    rows = found.join(docs.select(*keys, F.col("source").alias("_source")), list(keys))

    def one(source, found):
        return [rendering.annotated(d[path], source or "", d) for d in found]

    made = map_column(rows, "_report", "array<string>", one, ("_source", "_found"))
    return made.select(*keys, F.explode(F.arrays_zip("_found", "_report")).alias("x")).select(*keys, "x._found.*", F.col("x._report").alias("report"))
