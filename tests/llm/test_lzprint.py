import hashlib

import numpy as np

from lectern.llm import lzprint


def phrases(text):
    """Plain LZ78."""
    b, known, start = text.encode(), set(), 0
    for end in range(1, len(b) + 1):
        if b[start:end] not in known:
            known.add(b[start:end])
            start = end
    return known


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        f, g, h = (lzprint.fingerprint(x) for x in (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, lzprint.likeness(lzprint.read(f), lzprint.read(g)), lzprint.likeness(lzprint.read(f), lzprint.read(h))))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_documents_match_a_plain_loop(spark, sample):
    rows = list(sample.items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = got(lzprint.neighbour_likeness(df))
    assert out == expected(rows)
    assert np.mean([r[5] > r[6] for r in out]) > 0.97


def test_odd_rows(spark, odd, empty):
    from tests.llm.conftest import ODD

    assert got(lzprint.neighbour_likeness(odd)) == expected(ODD)
    assert got(lzprint.neighbour_likeness(empty)) == []
    assert got(lzprint.neighbour_likeness(spark.createDataFrame([(7, "only one here")], "doc_id long, text string"))) == expected([(7, "only one here")])
    assert lzprint.lz_fingerprints(odd).count() == len(ODD)


def test_phrases_are_those_of_lz78(sample):
    for t in [*list(sample.values())[:30], "aaaaaaaaaaaa", "", "é" * 50]:
        assert len(lzprint.Parse().feed(t.encode()).hashes) - 1 == len(phrases(t))


def test_likeness_estimates_jaccard(sample):
    texts = [t for t in sample.values() if len(t) > 2000][:12]
    for a in texts:
        for b in (a, a[: len(a) // 2] + texts[0], texts[-1]):
            x, y = phrases(a), phrases(b)
            est = lzprint.likeness(lzprint.read(lzprint.fingerprint(a)), lzprint.read(lzprint.fingerprint(b)))
            assert abs(est - len(x & y) / len(x | y)) < 0.16


def test_ids_keep_their_type(spark, sample):
    texts = list(sample.values())[:40]
    rows = [(f"id {i % 17:02} {i}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "name string, text string")
    assert got(lzprint.neighbour_likeness(df, "name")) == expected(rows)
    assert got(lzprint.neighbour_likeness(df.where("false"), "name")) == []
    df = spark.createDataFrame([(None, "a b c d"), ("", "e f g h"), ("é", "x y z")], "doc_id string, text string")
    out = {r.doc_id: r.edited_sha256 for r in lzprint.neighbour_likeness(df).collect()}
    assert out[None] == hashlib.sha256(b"a b c e").hexdigest() and out[""] == hashlib.sha256(b"e f g x").hexdigest()
    df = spark.createDataFrame(list(sample.items())[:20], "doc_id int, text string")
    out = lzprint.neighbour_likeness(df)
    assert out.schema["doc_id"].dataType.simpleString() == "int" and got(out) == expected(list(sample.items())[:20])
