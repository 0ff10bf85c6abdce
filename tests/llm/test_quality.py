import numpy as np

from lectern.llm import quality
from lectern.llm.langid import held_out

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.quality_query(spark, DIR)
    assert out.count() == 1000
    rows = out.where("held_out").join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.9, auc
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_scores_are_the_exact_vote(spark):
    rng = np.random.default_rng(1)
    docs = [quality.terms(bytes(rng.choice([97, 98, 32, 65], 50).astype(np.uint8))) for _ in range(40)]
    m = quality.Model(np.ones(quality.TERMS), quality.principal_axes(rng.standard_normal((40, quality.TERMS)).astype(np.float32), 8), np.zeros((0, 8)), (rng.random(40) > 0.5) * 1.0, rng.random(40) + 0.5, 0.5)
    m.vectors = m.embed(docs)
    got = m.score(docs, 5, block=7)
    e = m.embed(docs)
    for i in range(40):
        cos = m.vectors @ e[i]
        near = sorted(range(40), key=lambda j: -cos[j])[:5]
        w = [max(0, cos[j]) ** 4 * m.weight[j] for j in near]
        assert abs(got[i] - sum(a * m.label[j] for a, j in zip(w, near, strict=True)) / sum(w)) < 1e-4


def test_ties_go_by_place():
    """Of many equal neighbours the first count, as in a stable sort; so for every size of the model."""
    for n in (60, 1000, 4096):
        m = quality.Model(np.ones(quality.TERMS), np.zeros((quality.TERMS, 2), np.float32), np.zeros((n, 2), np.float32), np.zeros(n), np.ones(n), 0.5)
        m.vectors[:, 0] = 1
        m.vectors[::7] = (0, 1)
        m.label[: n // 10] = 1
        m.embed = lambda docs: np.array([[0.8, 0.6]] * len(docs), np.float32)
        near = sorted(range(n), key=lambda j: -float(m.vectors[j] @ np.array([0.8, 0.6], np.float32)))[:25]
        assert abs(m.score([None] * 3)[1] - np.mean([m.label[j] for j in near])) < 1e-6


def test_ids_with_both_labels_are_not_used(spark, odd):
    labels = spark.createDataFrame([(4, 1), (7, 0), (4, 0), (10, 1)], "doc_id long, quality int")
    assert sorted(quality.fit(odd, labels).label) == [0, 1]


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (4, 1), (7, 0), (8, None), (99, 1), (4, 1)], "doc_id long, quality int")
    m = quality.fit(odd, labels)
    out = quality.classify(odd, m).collect()
    assert len(out) == 11 and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    assert score[1] == score[2] == m.prior and score[4] > score[7]
    assert quality.classify(empty, quality.fit(empty, labels)).count() == 0
    none = quality.fit(odd, labels.where("false"))
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
