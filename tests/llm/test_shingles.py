import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lectern.llm import shingles


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow(rows):
    """(id, smallest id reached) by brute force."""
    sets = {}
    for i, t in rows:
        sets[i] = slow_set(t)
    low = {i: i for i in sets}
    for i in sorted(sets):
        todo = [i] if low[i] == i else []
        while todo:
            x = todo.pop()
            for y in sets:
                if low[y] == y and y > i and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                    low[y] = i
                    todo.append(y)
    return sorted((i, low[i]) for i, _ in rows)


def got(df):
    return sorted((r.doc_id, r.component_id) for r in df.collect())


def group(n, words, edits, seed):
    """Texts that are each some edits away from one."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.randrange(edits + 1)):
            own[draw.randrange(words)] = f"x{draw.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("rounds", [0, 2])
def test_components_match_brute_force(spark, sample, rounds):
    texts = [*sample.values(), *group(90, 120, 7, 1), *group(30, 60, 4, 2), *group(12, 400, 20, 3), "Two words", "two  WORDS", "a b c d e", "a b c d f"]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    want = slow(rows)
    assert len({c for _, c in want}) < len(rows) - 60
    assert got(shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds)) == want


def test_the_stage_keeps_one_of_each_group(spark, sample):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {i for i, c in slow(list(sample.items())) if i == c}
    assert len(want) < len(set(sample.values()))
    assert {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()} == want


def test_fingerprints_never_differ_more_than_their_sets():
    draw = random.Random(5)
    for _ in range(300):
        a = {draw.randrange(2**64) for _ in range(draw.randrange(1, 300))}
        b = set(draw.sample(sorted(a), draw.randrange(len(a)))) | {draw.randrange(2**64) for _ in range(draw.randrange(40))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        p, q = shingles.sketch(x), shingles.sketch(y)
        assert int(np.bitwise_count(shingles.folded(p, 8) ^ shingles.folded(q, 8)).sum()) <= len(a ^ b)
        assert shingles.folded(p, 8).tobytes() == shingles.sketch(x, 64)
        if 5 * len(a & b) >= 4 * len(a | b):
            assert shingles.may_link(p, len(a), q, len(b), (4, 5))


@pytest.mark.parametrize("step", [1 << 20, 64, 7])
def test_shingles_are_those_of_the_words(step, monkeypatch):
    """Equal where the words are, whatever comes before them and wherever a block of bytes ends."""
    whole = [shingles.shingle_sets([t])[0] for t in TEXTS]
    if step < 1 << 20:
        monkeypatch.setattr(shingles, "_STEP", step)
        for name in ("_POWER", "_INVERSE"):
            monkeypatch.setattr(shingles, name, getattr(shingles, name)[: step + 1])
    found = shingles.shingle_sets(TEXTS)
    assert all((a == b).all() for a, b in zip(whole, found, strict=True))
    own = {}
    for t, s in zip(TEXTS, found, strict=True):
        assert len(s) == len(slow_set(t.decode())) and own.setdefault(frozenset(slow_set(t.decode())), s.tobytes()) == s.tobytes()
    assert len(set(own.values())) == len(own)


TEXTS = [b"", b"  ", b"one", b"ONE\n", b"a b c d", b"a b  C d ", b"a b c d e", b"x a b c d e", b"\xc3\xa9 \xc3\x89 a b c d e", b"ab ba " * 300, b"long" * 400, b"ba ab", b"ab ba"]


def test_pairs_of_large_buckets(spark, monkeypatch):
    """Blocks, pivots and fingerprints lose no pair: buckets are large from three rows on."""
    for name, value in (("SMALL", 2), ("BLOCK", 16)):
        monkeypatch.setattr(shingles, name, value)
    texts = [*group(60, 120, 9, 1), *group(50, 60, 5, 2), *["the same long passage of common words " + t for t in group(40, 9, 0, 3)]]
    rows = list(enumerate(texts))
    assert got(shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0)) == slow(rows)


def test_a_large_bucket_makes_no_more_rows_than_it_is_given():
    """Whatever can be linked there, and all of it stays in one cluster."""
    sets = shingles.shingle_sets([t.encode() for t in [*group(150, 135, 9, 1), *group(150, 123, 9, 2)]])
    rows = [(7, 0, 0, len(s), i, i, shingles.sketch(s)) for i, s in enumerate(sets)]
    names = ["token", "block", "side", "n", "node", "label", "sketch"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    found = [p for b in shingles.of_large((4, 5))(iter([batch])) for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
    cluster = shingles.lowest(len(sets), *np.array(found).T)
    able = [(i, j) for i in range(len(sets)) for j in range(i) if shingles.may_link(rows[i][6], len(sets[i]), rows[j][6], len(sets[j]), (4, 5))]
    assert len(able) > 5 * len(rows) > 5 * len(found)
    assert all(cluster[i] == cluster[j] for i, j in able) and len(set(cluster)) >= 2


def test_long_texts_that_are_not_alike_make_no_cluster():
    sets = shingles.shingle_sets([t.encode() for s in range(40) for t in group(1, 2500, 0, s)])
    rows = [(7, 0, 0, len(s), i, i, shingles.sketch(s)) for i, s in enumerate(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["token", "block", "side", "n", "node", "label", "sketch"])
    assert not [b for b in shingles.of_large((4, 5))(iter([batch])) if b.num_rows]


@pytest.mark.parametrize(("wide", "heavy"), [(8_192, 2_000_000), (20, 2_000_000), (8_192, 3_000)])
def test_clusters_of_any_number_of_blocks(spark, monkeypatch, wide, heavy):
    for name, value in (("SMALL", 2), ("BLOCK", 16), ("WIDE", wide), ("HEAVY", heavy)):
        monkeypatch.setattr(shingles, name, value)
    rows = list(enumerate([*group(80, 130, 10, 1), *group(40, 90, 6, 2), *group(5, 3000, 150, 3)]))
    want = slow(rows)
    assert 10 < len({c for _, c in want}) < len(rows) - 30
    assert got(shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0)) == want


def test_odd_rows(odd, empty):
    from tests.llm.conftest import ODD

    assert got(shingles.near_copies(odd)) == slow(ODD)
    assert got(shingles.near_copies(empty)) == []
