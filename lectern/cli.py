"""`python -m lectern analyze|check FILE...`: reports on files, with the exit codes of a linter."""

from __future__ import annotations

import argparse
import math
import os
import sys
from functools import partial

from lectern.operators.analysis import Thresholds, analysed_rows, compact, diagnostics, file_analysis

CLEAN, FLAGGED, FAILED = 0, 1, 2


def positive(text: str) -> float:
    x = float(text)
    if not math.isfinite(x) or x <= 0:
        raise argparse.ArgumentTypeError(f"{text} is not a finite number above 0")
    return x


def count(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError(f"{text} is below 0")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    commands = p.add_subparsers(dest="mode", required=True)
    for mode, what in (("analyze", "report each file's metrics"), ("check", "report sentences that break a rule; exit 1 if any does")):
        c = commands.add_parser(mode, help=what)
        c.add_argument("files", nargs="+")
        c.add_argument("--model-path")
        c.add_argument("--format", choices=("text", "compact", "json"), default="text")
        t = Thresholds()
        c.add_argument("--max-sentence-len", type=count, default=t.max_sentence_len)
        c.add_argument("--max-mdd", type=positive, default=t.max_mdd)
        c.add_argument("--max-tree-depth", type=count, default=t.max_tree_depth)
        c.add_argument("--max-clauses", type=count, default=t.max_clauses)
    return p


def read(paths: list[str], err) -> tuple[list[tuple[int, str, str]], int]:
    """(place, path, source) of the files that are readable UTF-8; the others are named on `err`."""
    out, worst = [], CLEAN
    for i, path in enumerate(paths):
        try:
            with open(path, "rb") as f:
                out.append((i, path, f.read().decode()))
        except (OSError, UnicodeDecodeError) as e:
            print(f"lectern: cannot read {path}: {e}", file=err)
            worst = FAILED
    return out, worst


def main(argv: list[str] | None = None, spark=None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lectern.functions import rendering
    from lectern.functions.decoding import ModelError
    from lectern.sources import model
    from lectern.sources.documents import source_format

    parse = None
    if args.model_path:
        try:
            model.load(args.model_path)
        except ModelError as e:
            print(f"lectern: cannot load the model {args.model_path}: {e}", file=err)
            return FAILED
        parse = partial(model.load, args.model_path)
    else:
        print("lectern: no --model-path given; syntactic metrics skipped", file=err)
    sources, worst = read(args.files, err)
    if not sources and args.format != "json":
        return worst
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    docs = spark.createDataFrame(sources, "doc_id int, path string, source string").withColumn("format", source_format(F.col("path")))
    limits = Thresholds(args.max_sentence_len, args.max_mdd, args.max_tree_depth, args.max_clauses)
    rows = analysed_rows(docs, limits, ("doc_id", "path"), parser=parse).persist()
    files, sentences = file_analysis(rows, ("doc_id", "path")), rows.where("sentence is not null")
    try:
        by = {r.doc_id: r.asDict(recursive=True) for r in files.collect()}
        found: dict[int, list[dict]] = {i: [] for i, *_ in sources}
        for r in diagnostics(sentences, limits, ("doc_id", "path")).withColumn("compact", compact(F.col("path"))).orderBy("doc_id", "sent_ix").collect():
            found[r.doc_id].append(r.asDict(recursive=True))
        failed = {}
        for r in sentences.where("parse.status in ('too_long', 'error') or syntax.tree_error is not null").orderBy("doc_id", "sent_ix").collect():
            at = f"{r.path}:{r.line}:{r.column}"
            if r.parse.status == "too_long":
                print(f"lectern: {at}: sentence too long for the model ({r.parse.pieces} subword pieces, max {r.parse.max}); syntactic metrics skipped", file=err)
            else:
                cause = r.parse.error or f"the parse is not a tree: {r.syntax.tree_error}"
                failed.setdefault(r.doc_id, f"lectern: cannot parse the sentence at {at}: {cause}")
    finally:
        rows.unpersist()
    reports = []
    for i, path, source in sources:
        if i in failed:
            print(failed[i], file=err)
            worst = FAILED
            continue
        if args.mode == "check" and found[i]:
            worst = max(worst, FLAGGED)
        reports.append((path, by[i], found[i]))
        if args.format == "json":
            continue
        if args.mode == "analyze":
            print(rendering.table(path, by[i]), file=out)
        elif args.format == "compact":
            for d in found[i]:
                print(d["compact"], file=out)
        else:
            color = rendering.use_color(getattr(out, "isatty", lambda: False)(), os.environ.get("NO_COLOR"))
            for d in found[i]:
                print(rendering.annotated(path, source, d, color) + "\n", file=out)
    if args.format == "json":
        print(rendering.document(reports), file=out)
    return worst
