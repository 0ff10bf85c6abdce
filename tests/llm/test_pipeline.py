import re
from collections import defaultdict

import pytest

import corpus_pipeline
from lectern.llm import langid, pii, shingles, simhash
from tests.llm.conftest import ODD
from tests.llm.test_shingles import group, slow

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, documents before, result) of each stage on the smallest tables."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, DIR).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = ({r.doc_id: r for r in docs.collect()}, after.collect())
        docs = after
    return out


def test_language(stages):
    before, after = stages["language"]
    assert len(after) >= 0.97 * len(before)
    assert all(r.text == before[r.doc_id].text and r.source == before[r.doc_id].source for r in after)
    assert sum(r.lang == before[r.doc_id].lang for r in after) >= 0.97 * len(after)


def test_exact(stages):
    before, after = stages["exact_dedup"]
    low = {}
    for i in sorted(before):
        low.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", before[i].text), i)
    assert sorted(r.doc_id for r in after) == sorted(low.values()) and len(after) < len(before)
    assert all(r == before[r.doc_id] for r in after)


def test_near(stages):
    """One document of each group that a Jaccard similarity of 0.8 of five-word shingles links, by brute force."""
    before, after = stages["near_dedup"]
    kept = {i for i, low in slow([(i, r.text) for i, r in before.items()]) if i == low}
    assert {r.doc_id for r in after} == kept and len(kept) < len(before)
    assert all(r == before[r.doc_id] for r in after)


def test_near_links_by_fingerprints(spark, stages, monkeypatch):
    """The stage's first pairs are those of SimHash fingerprints of five-word shingles, and what these link is linked by them alone."""
    seen, verified = [], shingles.verified

    def spy(found, *rest):
        seen.append(found)
        return verified(found, *rest)

    monkeypatch.setattr(shingles, "verified", spy)
    monkeypatch.setattr(shingles, "stars", lambda least: lambda batches: (b.select(["node", "label"]).rename_columns(["u", "v"]).slice(0, 0) for b in batches))
    texts = group(60, 200, 6, 7)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], spark.read.parquet(f"{DIR}/documents.parquet").schema)
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, DIR).collect()}
    assert kept == {i for i, low in slow([*enumerate(texts)]) if i == low} and len(kept) < len(texts) - 40
    node = {r.n: simhash.fingerprint(r.text.encode(), 5) for r in docs.selectExpr("xxhash64(text) n", "text").collect()}
    first = [(r.u, r.v) for r in seen[0].collect()]
    assert len(first) > 40 and all((node[u] ^ node[v]).bit_count() <= simhash.NEAR for u, v in first)


def test_private(stages):
    before, after = stages["pii"]
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        old = before[r.doc_id]
        found = pii.spans(old.text)
        assert (r.text == old.text) == (not found) and r.n_chars == len(r.text) and r.lang == old.lang
        assert not [1 for a, b, _ in found if old.text[a:b] in r.text]


def test_packed(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after} == set(before)
    by = defaultdict(list)
    for r in after:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024


def test_run_gives_the_last_stages_rows(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, DIR).collect()) == key(stages["packing"][1])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", "s", len(t or ""), "x") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, id string")
    for rows in (docs, docs.where("false"), docs.where("doc_id = 1")):
        for name, f in corpus_pipeline.STAGES:
            rows = f(spark, rows, DIR)
            if name == "language":
                assert not {r.doc_id for r in rows.collect()} & {1, 2, 3}
        rows.collect()


def test_rejected_languages(spark):
    t = spark.read.parquet(f"{DIR}/documents.parquet")
    bad = spark.createDataFrame([(10**6, "123 !!! 456", "en", "s", 11), (10**6 + 1, None, "en", "s", 0)], t.schema)
    out = corpus_pipeline.language(spark, t.union(bad), DIR)
    assert out.where("doc_id >= 1000000").count() == 0 and langid.UNDETERMINED not in {r.lang for r in out.collect()}
