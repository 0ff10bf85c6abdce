import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tok():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check(rows, texts, tok, capacity=1024, repeated=None):
    """Every piece once, cut as agreed, sequences gapless and not overfull. Returns the number of sequences."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        if i == repeated:
            continue
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        assert len(own) == -(-len(ids) // capacity) and all(r.length == capacity for r in own[1:])
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_documents(spark, sample, tok):
    df = spark.createDataFrame(list(sample.items()), "doc_id long, text string")
    rows = packing.pack_documents(df, PATH, 2, public_tokenizers.PATTERN).collect()
    n = check(rows, sample, tok)
    assert n <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_odd_rows(odd, empty, tok):
    from tests.llm.conftest import ODD

    rows = packing.pack_documents(odd, PATH, 2, public_tokenizers.PATTERN).collect()
    assert sum(r.doc_id == 5 for r in rows) == 2
    check(rows, {i: t for i, t in ODD}, tok, repeated=5)
    assert packing.pack_documents(empty, PATH, 2, public_tokenizers.PATTERN).collect() == []


def test_split_encoding_is_the_tokenizers(tok, sample):
    texts = [*sample.values(), "<|endoftext|> x", "  a\n\n b\t", "²½ 漢字\x1c\x85", "😀 don't"]
    whole = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.token_bytes(texts, PATH, public_tokenizers.PATTERN) == whole == packing.token_bytes(texts, PATH, None)
    assert packing._fast(PATH, public_tokenizers.PATTERN) is not None


def test_fast_encoder_agrees_on_every_token(tok):
    words = [tok.decode([i]) for i in range(tok.get_vocab_size())]
    words = [w for w in words if w and "\ufffd" not in w]
    whole = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(words, add_special_tokens=False)]
    assert [w for w, a, b in zip(words, packing.token_bytes(words, PATH, public_tokenizers.PATTERN), whole, strict=True) if a != b] == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x180) | st.sampled_from(" \n\t'"), max_size=60))
def test_any_text(tok, text):
    assert packing.token_bytes([text], PATH, public_tokenizers.PATTERN)[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_exact_fit_keeps_every_item():
    for seed in range(20):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 200))]
        p = packing.Packing(sizes, 60).exact_fit(rng if seed % 2 else None)
        assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) == 60 - s and s >= 0 for b, s in zip(p.bins, p.space, strict=True))


def test_many_shards_and_migration(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([1, 300, 341, 500, 512, 700, 1024, rng.randint(1, 1024)]) for i in range(3000)}
    rows = packing.pack(spark.createDataFrame(list(sizes.items()), "item long, length long"), shard=500).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, sizes[r.item]))
    assert sorted(r.item for r in rows) == sorted(sizes)
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024


def test_crossover_and_evolution_keep_every_item():
    rng = random.Random(1)
    sizes = [rng.randint(200, 600) for _ in range(300)]
    a = packing.Packing(sizes, 1024).best_fit(list(range(300)))
    b = packing.Packing(sizes, 1024).best_fit(sorted(range(300), key=lambda i: -sizes[i]))
    for _ in range(20):
        for c in (a.crossover(b, rng), b.mutated(rng)):
            assert sorted(i for x in c.bins for i in x) == list(range(300))
            assert all(sum(sizes[i] for i in x) == 1024 - s and s >= 0 for x, s in zip(c.bins, c.space, strict=True))
    pool = packing.evolve(sizes, 1024, 3, work=30 * 8 * len(sizes))
    assert len(pool[0].bins) <= len(b.bins)


def test_generations_beat_best_fit():
    """On fixed sets of 400 sizes the islands need fewer bins than best fit of falling sizes, and than their own first packings."""
    saved = []
    for seed in (0, 1, 2, 3, 5):
        r = random.Random(seed)
        sizes = [r.randint(100, 700) for _ in range(400)]
        fit = packing.Packing(sizes, 1024).best_fit(sorted(range(400), key=lambda i: -sizes[i]))
        first, last = packing.evolve(sizes, 1024, 1, work=0)[0], packing.evolve(sizes, 1024, 1)[0]
        assert packing.least_bins(sizes, 1024) <= len(last.bins) <= min(len(fit.bins), len(first.bins))
        saved.append(min(len(fit.bins), len(first.bins)) - len(last.bins))
    assert min(saved) >= 1


def test_no_packing_is_under_the_bound():
    def fewest(sizes, spaces=()):
        if not sizes:
            return len(spaces)
        n, rest = sizes[0], sizes[1:]
        return min([fewest(rest, (*spaces, 10 - n)), *[fewest(rest, (*spaces[:i], s - n, *spaces[i + 1 :])) for i, s in enumerate(spaces) if s >= n]])

    r = random.Random(1)
    for _ in range(150):
        sizes = [r.randint(1, 9) for _ in range(r.randint(1, 7))]
        assert -(-sum(sizes) // 10) <= packing.least_bins(sizes, 10) <= fewest(sizes)
    assert packing.least_bins([], 10) == 0 and packing.least_bins([6] * 5, 10) == 5
