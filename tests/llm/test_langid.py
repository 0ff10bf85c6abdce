import pytest
import numpy as np
import pyarrow.parquet as pq

from lectern.llm import langid


def rows():
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], t["lang"], strict=True))


def model(spark):
    return langid.fit(spark.createDataFrame(rows(), "doc_id long, text string, lang string").where(~langid.held_out()))


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    out = langid.identify(df, model(spark)).join(df, "doc_id").where(langid.held_out()).collect()
    assert len(out) > 40
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_mixture_is_recovered(spark):
    m = model(spark)
    long = {}
    for _, t, lang in rows():
        if "!!" not in t and len(t) > len(long.get(lang, "")):
            long[lang] = t
    en, de = long["en"][:3000], long["de"][:1500]
    assert len(de) > 1000
    _, _, (s,) = m.predict([en + " " + de])
    share = dict(s)
    assert set(share) == {"en", "de"} and abs(share["en"] - len(en) / len(en + de)) < 0.1
    assert m.predict([en])[2][0][0][0] == "en" and len(m.predict([en])[2][0]) == 1


def test_em_never_lowers_the_likelihood(spark):
    m = model(spark)
    g = np.bincount(langid.grams(rows()[0][1]), minlength=langid.BUCKETS)
    b = np.flatnonzero(g)
    last = -np.inf
    for rounds in range(1, 8):
        _, like = m.mixture([(b, g[b])], rounds, 0)
        assert like[0] >= last - 1e-6
        last = like[0]


def test_odd_rows(spark, odd, empty):
    m = model(spark)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, m).collect()}
    assert [out[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(out[i][0] in m.langs for i in (4, 5, 6, 7, 8, 9, 10))
    assert langid.identify(odd, m).count() == 11
    assert langid.identify(empty, m).count() == 0
    nothing = langid.fit(empty.selectExpr("doc_id", "text", "text as lang"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


def test_mixtures_match_a_plain_loop():
    """The vectorised EM and choice of sets, against the same written plainly for one document at a time."""
    rng = np.random.default_rng(5)
    langs = ["a", "b", "c"]
    p = rng.dirichlet(np.full(langid.BUCKETS, 0.05), 3).T + 1e-9
    m = langid.Model(langs, p / p.sum(0))
    docs = []
    for mix in ((1, 0, 0), (0.5, 0.5, 0), (0.2, 0.3, 0.5), (0, 0.9, 0.1), (0, 0, 1)) * 2:
        n = np.bincount(rng.choice(langid.BUCKETS, rng.integers(1, 400), p=m.p @ np.array(mix)), minlength=langid.BUCKETS)
        docs.append((np.flatnonzero(n), n[np.flatnonzero(n)]))
    got, _ = m.mixture(docs)

    def em(b, c, own, times):
        share = {k: 1 / len(own) for k in own}
        for _ in range(times):
            new = dict.fromkeys(own, 0.0)
            for x, n in zip(b, c, strict=True):
                total = sum(share[k] * m.p[x, k] for k in own)
                for k in own:
                    new[k] += n * share[k] * m.p[x, k] / total / sum(c)
            share = new
        return share, sum(n * np.log(sum(share[k] * m.p[x, k] for k in own)) for x, n in zip(b, c, strict=True))

    for (b, c), row in zip(docs, got, strict=True):
        every, _ = em(b, c, range(3), 10)
        order = sorted(range(3), key=lambda k: -every[k])
        best, like = em(b, c, order[:1], 0)
        for more in (2, 3):
            share, now = em(b, c, order[:more], 10)
            if now - like <= max(np.log(sum(c)) / 2, 0.02 * sum(c)):
                break
            best, like = share, now
        assert np.allclose(row, [best.get(k, 0) for k in range(3)], atol=1e-9)


def test_a_column_of_many_values_is_none_of_languages(spark):
    df = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(12)], "text string, lang string")
    assert len(langid.fit(df, most=12).langs) == 12
    with pytest.raises(ValueError, match="over 11"):
        langid.fit(df, most=11)
