"""Parses as CoNLL-U: blocks of lines `ID FORM LEMMA UPOS XPOS FEATS HEAD DEPREL ...` parted by blank lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = "array<struct<id:int,form:string,lemma:string,upostag:string,head:int,deprel:string>>"


def tokens(block: Column) -> Column:
    """The tokens of one sentence's block; comments, multiword ranges (`7-8`) and empty nodes (`8.1`) are skipped."""
    rows = F.filter(F.transform(F.split(block, r"\r?\n"), lambda line: F.split(line, r"\t| +")), lambda f: (F.size(f) >= 8) & f[0].rlike(r"\A[0-9]+\z"))
    return F.transform(rows, lambda f: F.struct(f[0].cast("int").alias("id"), f[1].alias("form"), f[2].alias("lemma"), f[3].alias("upostag"), f[6].cast("int").alias("head"), f[7].alias("deprel")))


def text(block: Column) -> Column:
    """The sentence's text from its `# text = ` comment, null without one."""
    found = F.regexp_extract(block, r"(?m)^# text = (.*)$", 1)
    return F.when(found != "", found)


def sentence_blocks(source: Column) -> Column:
    """A file's blocks."""
    return F.filter(F.split(source, r"(?:\r?\n){2,}"), lambda b: F.trim(b) != "")
