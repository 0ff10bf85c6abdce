import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="session")
def real():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD_TEXTS = ["", " ", "  a", "\n\n x\t", "<|endoftext|>", "²½①", "a\x1c b\x85c\xa0d", "漢字 テスト", "é ‍👩‍👩‍👧", "x" * 20_000, "ab" * 3_000 + "é" * 500, "1234567 12_34 __ don't WE'LL", "ſ K", "aaaa" * 40, "=" * 300]


def test_ids_are_tiktokens(real, sample):
    v = bpe.load(PATH)
    texts = [*sample.values(), *ODD_TEXTS]
    ids = v.encode_batch(texts, public_tokenizers.PATTERN, {})
    assert ids == [real.encode_ordinary(t) for t in texts]
    assert [v.decode(x) for x in ids] == [t.encode() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(real, text):
    v = bpe.load(PATH)
    assert v.encode_batch([text], public_tokenizers.PATTERN, {})[0] == real.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abethionr é"), min_size=1, max_size=400).map("".join))
def test_heap_and_matrix_agree(text):
    v = bpe.load(PATH)
    b = text.encode()
    assert v.merge_long(b) == v.merge_rows([b, b[::-1]])[0]


def test_query_columns(spark, odd, real):
    from tests.llm.conftest import ODD

    out = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_encode(odd, PATH, public_tokenizers.PATTERN, digest=True).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in ODD:
        ids = real.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert out == sorted(want)


def test_round_trip(spark, sample):
    df = spark.createDataFrame(list(sample.items())[:50], "doc_id long, text string")
    back = bpe.bpe_decode(bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert {r.doc_id: bytes(r.bytes).decode() for r in back.collect()} == dict(list(sample.items())[:50])


def test_empty_table(empty):
    assert bpe.bpe_encode(empty, PATH, public_tokenizers.PATTERN, digest=True).collect() == []
