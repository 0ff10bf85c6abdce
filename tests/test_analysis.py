import io
import json

import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern.functions import lexical, rendering, scores
from lectern.operators import analysis, segment, surface
from tests.parses import EMBEDDED, PARSES
from lectern.sources.conllu import TOKENS

TAIL = "Whoever walks down to the harbour on a winter evening will see how the lamps along the quay are lit one after another by an old man who never hurries."
LONG = f"# The harbour\n\nTiny first remark. {TAIL}\n\nThat is all.\n"
SAMPLE = f"---\ntitle: Notes\n---\n\n# No prose here\n\n{EMBEDDED[0]}\n\n- Bread from [the mill](https://example.org).\n- Salt kept in `jar` form.\n\n> Somebody said this.\n\n```sh\nls\n```\n"
NOMINAL = "The assessment of her performance was a disappointment to a majority of people, and the decision hurt.\n"


def docs(spark, *rows):
    return spark.createDataFrame([(i, s, f) for i, (s, f) in enumerate(rows)], "doc_id int, source string, format string")


def test_scores(spark):
    (r,) = spark.range(1).select(*scores.readability(F.lit(100), F.lit(5), F.lit(150), F.lit(10)), *[c.alias(f"n{i}") for i, c in enumerate(scores.readability(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))]).collect()
    assert abs(r.flesch_reading_ease - 59.635) < 1e-9 and abs(r.flesch_kincaid_grade - 9.91) < 1e-9 and r.average_sentence_length == 20 and r.n0 is None


#: Words and the syllables that the heuristic counts in them.
SYLLABLES = [("window", 2), ("harbour", 2), ("every", 3), ("lamps", 1), ("wanted", 2), ("walked", 1), ("boxes", 1), ("fire", 2), ("quality", 3), ("likely", 2), ("lonely", 2), ("area", 2), ("video", 3), ("racism", 3), ("the", 1), ("shh", 1), ("people", 3), ("rhythm", 1)]


def test_syllables(spark):
    got = {r.w: r.n for r in spark.createDataFrame([(w,) for w, _ in SYLLABLES], "w string").select("w", lexical.count_syllables(F.col("w")).alias("n")).collect()}
    assert not {w: (got[w], n) for w, n in SYLLABLES if got[w] != n}


def test_lemmas_and_nominalizations(spark):
    words = ["Cities", "glass", "committee's", "decisions", "implementations", "nations", "s", "ies", "tidies", "Dogs’", "stations", "ability", "ment", "aliment"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", lexical.surface_lemma(F.col("w")).alias("l")).withColumn("n", lexical.is_nominalization(F.col("l"))).collect()
    got = {r.w: (r.l, r.n) for r in rows}
    assert got["Cities"] == ("city", False) and got["glass"][0] == "glass" and got["committee's"][0] == "committee" and got["decisions"] == ("decision", True)
    assert got["implementations"] == ("implementation", True) and got["nations"] == ("nation", False) and got["Dogs’"] == ("dog", False)
    assert got["tidies"][0] == "tidy" and got["ability"][1] and not got["ment"][1]


def test_files(spark):
    files, _ = analysis.analyze(docs(spark, (SAMPLE, "markdown"), ("Plain text is one span.\nEven *this* line.\n", "plain"), ("# Only a heading", "markdown"), ("", "markdown"), ("", "plain"), (NOMINAL, "markdown"), (LONG, "markdown")))
    by = {r.doc_id: r for r in files.collect()}
    assert (by[0].sentences, by[0].prose_spans) == (4, 7)
    assert (by[1].sentences, by[1].syllables, by[1].complex_words, by[1].prose_spans, by[1].words) == (2, 9, 0, 1, 8)
    for k, spans in ((2, 0), (3, 0), (4, 1)):
        assert (by[k].prose_spans, by[k].words, by[k].sentences, by[k].flesch_reading_ease, by[k].nominalization_ratio, by[k].passives) == (spans, 0, 0, None, None, None)
    assert (by[5].nominalizations, by[5].words) == (5, 17)
    assert by[6].sentences == 3 and by[0].mdd_absence == "no parse"


def test_surface_and_segment_paths_agree(spark):
    plain = docs(spark, ("One two. Three four five? Yes.\n\nAnother Dr. Smith block.", "plain"), ("", "plain"), ("  \n ", "plain"))
    files, _ = analysis.analyze(plain)
    a = {r.doc_id: r for r in files.collect()}
    for r in surface.document_metrics(plain, ("doc_id",)).collect():
        for c in (*surface.COUNTS, "prose_spans", "nominalizations", *scores.SCORES):
            assert r[c] == a[r.doc_id][c], c


def test_long_sentence_diagnostic(spark):
    for most, n in ((29, 1), (30, 0)):
        t = analysis.Thresholds(max_sentence_len=most)
        _, s = analysis.analyze(docs(spark, (LONG, "markdown")), t)
        assert analysis.diagnostics(s, t).count() == n
    t = analysis.Thresholds()
    _, s = analysis.analyze(docs(spark, (LONG, "markdown")), t)
    (d,) = analysis.diagnostics(s, t).withColumn("line_", analysis.compact(F.lit("long.md"))).collect()
    assert (d.line, d.column) == (3, 20)
    assert d.line_ == "long.md:3:20: CognitiveOverload: LongSentence: sentence has 30 words (max 25)"
    text = rendering.annotated("long.md", LONG, d.asDict(recursive=True))
    assert text.split("\n")[:5] == ["warning[CognitiveOverload]: Sentence exceeds human working-memory capacity", " --> long.md:3:20", "  |", f"3 | {LONG.splitlines()[2]}", "  | " + " " * 19 + "^" * (len(LONG.splitlines()[2]) - 19)]
    assert text.split("\n")[5:] == ["  |", "  = metrics:", "    - words: 30 (LongSentence, max 25)", "    - mean dependency distance: absent (no parse)", "    - tree depth: absent (no parse)", "    - subordinate clauses: absent (no parse)", "    - center-embedding: absent (no parse)", "  = help: Split the sentence into shorter ones."]


def test_parsed_example(spark):
    parses = spark.createDataFrame(PARSES, f"sentence string, tokens {TOKENS}")
    t = analysis.Thresholds(max_mdd=2.5)
    files, s = analysis.analyze(docs(spark, (EMBEDDED[0], "plain"), (" ".join(x for x, _ in PARSES), "plain"), ("Not parsed.", "plain")), t, parses=parses)
    (d,) = analysis.diagnostics(s.where("doc_id = 0"), t).collect()
    assert d.metrics == ["words: 13 (max 25)", "mean dependency distance: 2.67 (HighMdd, max 2.50)", "tree depth: 4 edges (max 5)", "subordinate clauses: 1 (max 2)", 'center-embedding: subject "proposal" separated from verb "caused" by 8 words (CenterEmbedding)']
    assert [f.name for f in d.flags] == ["HighMdd", "CenterEmbedding"] and len(d.advice) == 2
    by = {r.doc_id: r for r in files.collect()}
    assert by[1].passives == 2 and by[2].passives is None and by[2].mdd_absence == "no parse" and by[0].mean_dependency_distance == 32 / 12


def test_two_places(spark):
    xs = [0.125, 0.375, 1.005, 1.015, 2.675, 1.115, 32 / 12, 2.5, 0.0, 3.145, 8.345]
    got = [r.t for r in spark.createDataFrame([(x,) for x in xs], "x double").select(analysis.two_places(F.col("x")).alias("t")).collect()]
    assert got == [f"{x:.2f}" for x in xs]


def test_native_positions(spark):
    s = "aé\nb\n漢c"
    from lectern.functions.segmentation import position

    n = len(s.encode())
    rows = spark.createDataFrame([(s, i) for i in range(n + 2)], "s string, i int").select("i", segment.line_column(F.col("s"), F.col("i")).alias("p")).collect()
    for r in rows:
        try:
            want = position(s, r.i)
        except (IndexError, ValueError):
            want = None
        assert (tuple(r.p) if r.p else None) == want, r.i


def test_wide_characters_and_tabs(spark):
    t = analysis.Thresholds(max_sentence_len=0)
    for source, carets, column in (("漢字 is here now.\n", 17, 16), ("Ab\there now.\n", 15, 13)):
        _, s = analysis.analyze(docs(spark, (source, "plain")), t)
        (d,) = analysis.diagnostics(s, t).collect()
        assert d.end_column == column
        assert rendering.annotated("s", source, d.asDict(recursive=True)).count("^") == carets


def run(spark, *args):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(args), spark, out, err), out.getvalue(), err.getvalue()


def test_command_line(spark, tmp_path):
    for name, text in (("long.md", LONG), ("sample.md", SAMPLE), ("plain.txt", "Plain text is one span.\nEven *this* line.\n"), ("wrapped.md", "Brief start.  Here are words\nthat go on over the next line\nand stop on the last of them.\n")):
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    at = lambda n: str(tmp_path / n)
    code, out, err = run(spark, "analyze", at("plain.txt"))
    assert code == 0 and out.splitlines()[0].endswith("plain.txt: 1 prose spans, 8 words") and "  syllables                 9" in out and "passive voice             absent (no parse)" in out and "syntactic metrics skipped" in err
    code, out, _ = run(spark, "check", at("sample.md"), at("long.md"), "--format", "compact")
    assert code == 1 and out.splitlines() == [f"{at('long.md')}:3:20: CognitiveOverload: LongSentence: sentence has 30 words (max 25)"]
    code, out, err = run(spark, "check", at("sample.md"), at("bad.md"), at("missing.md"), "--format", "json")
    assert code == 2 and "bad.md" in err and "missing.md" in err
    d = json.loads(out)
    assert d["schema_version"] == 1 and list(d["files"][0]["metrics"]) == list(rendering._METRICS) and d["files"][0]["metrics"]["passives"] is None
    code, out, _ = run(spark, "check", at("wrapped.md"), "--max-sentence-len", "5")
    assert code == 1 and "wrapped.md:1:15" in out and out.count("|_") == 1 and "3 | | and stop on the last of them." in out
    assert run(spark, "check")[0] == 2 and run(spark, "check", at("long.md"), "--max-mdd", "-1")[0] == 2
    assert run(spark, "check", at("long.md"), "--model-path", at("nothing"))[0] == 2


def test_parser_seam(spark):
    from lectern.operators import syntax

    class Fake:
        def parse(self, text):
            if "bad" in text:
                raise ValueError("no")
            if "long" in text:
                return {"status": "too_long", "tokens": None, "pieces": 600, "max": 509}
            return {"status": "parsed", "tokens": [{"id": 1, "form": "x", "lemma": "_", "upostag": "X", "head": 0, "deprel": "root"}]}

    s = spark.createDataFrame([("bad",), ("long",), ("fine",)], "sentence string")
    got = {r.sentence: r for r in analysis.sentence_analysis(syntax.with_syntax(syntax.with_parser(s, Fake))).collect()}
    assert got["bad"].parse.error == "no" and got["long"].mdd_absence == "too long for the model" and got["fine"].mdd_absence == "no content dependency" and got["fine"].syntax.depth == 0


class Counting:
    """A parser that writes down what it is asked."""

    def __init__(self, path):
        self.path = path

    def parse(self, text):
        with open(self.path, "a") as f:
            f.write(text + "\n")
        if "bad" in text:
            raise ValueError("no " + text[0])
        heads = [0, 1, 1, 1]
        return {"status": "parsed", "tokens": [{"id": i + 1, "form": w, "lemma": "_", "upostag": "X", "head": heads[i], "deprel": "aux:pass" if i == 1 else "dep"} for i, w in enumerate(text.rstrip(".").split()[:4])]}


def test_each_sentence_is_parsed_once(spark, tmp_path):
    from functools import partial

    source = docs(spark, ("Seen is one. Two was here.", "plain"), ("# Head", "markdown"))
    files, s = analysis.analyze(source, parser=partial(Counting, str(tmp_path / "asked")))
    assert s.count() == 2 and files.count() == 2 and analysis.passive_positions(s).count() == 2
    assert sorted((tmp_path / "asked").read_text().splitlines()) == ["Seen is one.", "Two was here."]
    spark.catalog.clearCache()


def test_a_files_error_is_its_first(spark, tmp_path):
    from functools import partial

    source = docs(spark, ("Zero bad. A bad one. Fine.", "plain"), ("Fine.", "plain"))
    files, _ = analysis.analyze(source, parser=partial(Counting, str(tmp_path / "asked")))
    assert {r.doc_id: r.error for r in files.collect()} == {0: "no Z", 1: None}
    spark.catalog.clearCache()


def test_documents_of_one_key_are_summed(spark):
    two = spark.createDataFrame([(1, "One two.\n\nThree.", "plain"), (1, "Four five six.", "plain")], "doc_id int, source string, format string")
    (r,) = analysis.analyze(two)[0].collect()
    assert (r.prose_spans, r.block_words, r.words, r.sentences) == (2, 6, 6, 3)


def test_passive_positions(spark):
    """A verb is found through the block's pieces, behind markup and wide characters, or else its sentence's start stands in."""
    from lectern.operators import syntax

    source = "é **Rain** was\n*seen* here. Other words.\n"
    rows = segment.sentence_rows(segment.segment(docs(spark, (source, "markdown"))))
    forms = {"é Rain was seen here.": ("é", "Rain", "was", "seen", "here"), "Other words.": ("Others", "word", "be", "unseen")}
    parses = spark.createDataFrame([(t, [(i + 1, w, "_", "X", 0 if i == 3 else 4, "aux:pass" if i == 2 else "dep") for i, w in enumerate(f)]) for t, f in forms.items()], f"sentence string, tokens {TOKENS}")
    got = {r.verb: r.offset for r in analysis.passive_positions(syntax.with_syntax(syntax.with_known_parses(rows, parses), ("passives",))).collect()}
    data = source.encode()
    assert got == {"seen": data.index(b"seen"), "unseen": data.index(b"Other")}


def test_stream(spark, tmp_path):
    from lectern.streaming.documents import diagnostic_stream

    schema = "doc_id int, source string, format string"
    docs(spark, (LONG, "markdown"), ("Short.", "plain")).write.parquet(str(tmp_path / "in"))
    q = diagnostic_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.line, r.column) for r in spark.table("found").collect()] == [(3, 20)]


def test_files_source(spark, tmp_path):
    from lectern.sources.documents import read_files

    (tmp_path / "a.MD").write_text("x")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    got = {r.path[-4:]: (r.source, r.format, r.status) for r in read_files(spark, [str(tmp_path / "a.MD"), str(tmp_path / "b.txt")]).collect()}
    assert got == {"a.MD": ("x", "markdown", "ok"), ".txt": (None, "plain", "unreadable")}
    got = {r.path[-4:]: (r.source, r.status) for r in read_files(spark, [str(tmp_path / n) for n in ("a.MD", "no.md", "b.txt")]).collect()}
    assert got == {"a.MD": ("x", "ok"), "o.md": (None, "missing"), ".txt": (None, "unreadable")}
    assert [(r.format, r.status) for r in read_files(spark, [str(tmp_path / "no.md")]).collect()] == [("markdown", "missing")]


@pytest.mark.parametrize("tty,no_color,want", [(True, None, True), (True, "", True), (True, "1", False), (False, None, False)])
def test_color(tty, no_color, want):
    assert rendering.use_color(tty, no_color) == want
