"""The surface and segment operators over streams: they hold no state, so a stream is analysed row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.operators import analysis, segment


def sentence_stream(docs: DataFrame, thresholds: analysis.Thresholds = analysis.Thresholds(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Analysed sentences of a streaming DataFrame (keys, source, format); nothing is shuffled or remembered."""
    return analysis.sentence_analysis(segment.sentence_rows(segment.segment(docs, keys), keys), thresholds)


def diagnostic_stream(docs: DataFrame, thresholds: analysis.Thresholds = analysis.Thresholds(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return analysis.diagnostics(sentence_stream(docs, thresholds, keys), thresholds, keys)
