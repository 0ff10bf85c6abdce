import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions import decoding, trees
from tests.parses import EMBEDDED, NOMINAL, PARSES, PASSIVE, tokens


def tree_of(heads, upos=None, deprel=None):
    n = len(heads)
    return [{"id": i + 1, "form": f"w{i + 1}", "lemma": "_", "upostag": (upos or ["X"] * n)[i], "head": h, "deprel": (deprel or ["dep"] * n)[i]} for i, h in enumerate(heads)]


def test_witnesses():
    t = tokens(EMBEDDED[1])
    c = trees.content(t)
    assert trees.dependency_distance(c) == (32, 12) and max(trees.depths(c)) == 4
    assert sum(trees.is_clausal(x["deprel"]) for x in c) == 1
    assert trees.center_embeddings(t, c) == [{"subject": "proposal", "verb": "caused", "words_between": 8}]
    t = tokens(PASSIVE[1])
    assert trees.passive_heads(t) == [4, 13]
    assert trees.passives(t, PASSIVE[0]) == [{"verb": "written", "at": 15}, {"verb": "rejected", "at": 68}]


@pytest.mark.parametrize("heads,error", [([], "Empty"), ([2, 0, 5], "HeadOutOfRange"), ([0, 0], "SeveralRoots"), ([2, 1], "Cycle"), ([0, 3, 2], "Cycle"), ([0, 1, 1], None), ([2, 0], None), ([2, 3, 2], "Cycle")])
def test_tree_errors(heads, error):
    assert trees.tree_error(tree_of(heads)) == error


def test_order_of_errors():
    t = tree_of([9, 0])
    t[1]["id"] = 7
    assert trees.tree_error(t) == "IdOutOfOrder"


def test_punctuation_is_passed_over():
    c = trees.content(tree_of([2, 3, 4, 0], ["X", "PUNCT", "PUNCT", "X"]))
    assert [(t["cid"], t["chead"]) for t in c] == [(1, 2), (2, 0)]
    c = trees.content(tree_of([3, 3, 0], ["X", "X", "PUNCT"]))
    assert trees.dependency_distance(c) == (0, 0)


def test_chain_and_star_pool():
    chain, star = trees.content(tree_of([0, 1])), trees.content(tree_of([0, 1, 1, 1]))
    a, b = trees.dependency_distance(chain), trees.dependency_distance(star)
    assert (a[0] + b[0]) / (a[1] + b[1]) == 7 / 4
    assert max(trees.depths(trees.content(tree_of([0, 1, 2, 3, 4])))) == 4


@st.composite
def random_trees(draw):
    n = draw(st.integers(1, 20))
    order = draw(st.permutations(range(1, n + 1)))
    heads = [0] * n
    for k, i in enumerate(order[1:], 1):
        heads[i - 1] = order[draw(st.integers(0, k - 1))]
    upos = draw(st.lists(st.sampled_from(["NOUN", "VERB", "PUNCT"]), min_size=n, max_size=n))
    deprel = draw(st.lists(st.sampled_from(["nsubj", "acl:relcl", "advcl", "obj", "aux:pass", "nsubj:pass"]), min_size=n, max_size=n))
    return tree_of(heads, upos, deprel)


@settings(max_examples=200, deadline=None)
@given(random_trees())
def test_laws(t):
    assert trees.tree_error(t) is None
    c = trees.content(t)
    total, n = trees.dependency_distance(c)
    assert total >= n == sum(x["chead"] != 0 for x in c)
    for x, d, (lo, hi) in zip(c, trees.depths(c), trees.spans(c), strict=True):
        below = [y["cid"] for y in c if x["cid"] in ancestors(c, y)]
        assert (lo, hi) == (min(below), max(below)) and d == len(ancestors(c, x)) - 1


def ancestors(c, x):
    out = [x["cid"]]
    while x["chead"]:
        x = c[x["chead"] - 1]
        out.append(x["cid"])
    return out


def test_alignment():
    assert trees.align(["a", "zz", "b"], "a x b") == [0, None, 4]
    assert trees.align(["do", "n't", "go"], "don't  go") == [0, 2, 7]


def brute(score):
    n = len(score)
    best = None
    for heads in itertools.product(range(n), repeat=n):
        if all(any(at == heads[at] or at == d for at in [at]) for d in range(n) for at in [d]) and acyclic(heads):
            s = sum(score[h][d] for d, h in enumerate(heads))
            if best is None or s > best:
                best = s
    return best


def acyclic(heads):
    for d in range(len(heads)):
        at, seen = d, set()
        while heads[at] != at:
            if at in seen:
                return False
            seen.add(at)
            at = heads[at]
    return True


def test_spanning_forest_is_maximal():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        score = rng.integers(-9, 9, (n, n)).astype(np.float32)
        heads = decoding.spanning_forest(score)
        assert acyclic(heads) and sum(score[h, d] for d, h in enumerate(heads)) == brute(score)
        assert len(decoding.roots(decoding.one_root(score))) == 1


LABELS = decoding.Labels(["X|_|X", "X|_|goeswith", "VERB|_|root", "NOUN|_|nsubj", "NOUN|_|obj", "PUNCT|_|punct"])


def scores(n, cells):
    s = np.full((n, n, 6), -5, np.float32)
    for h, d, k in cells:
        s[h, d, k] = 10
    return s


def test_decode():
    s = scores(3, [(0, 1, 1), (2, 0, 3), (2, 2, 2)])
    out = decoding.decode(s, LABELS, "abcd efg", [(0, 2), (2, 4), (5, 8)])
    assert [(t["form"], t["head"], t["deprel"], t["upostag"]) for t in out] == [("abcd", 2, "nsubj", "NOUN"), ("efg", 0, "root", "VERB")]
    out = decoding.decode(scores(2, [(0, 0, 2), (1, 1, 2)]), LABELS, "a b", [(0, 1), (2, 3)])
    assert sum(t["head"] == 0 for t in out) == 1


def test_model_configuration():
    ok = '{"max_position_embeddings": 514, "pad_token_id": 1}'
    assert decoding.max_pieces(ok) == 509
    for bad in ('{"pad_token_id": 1}', '{"max_position_embeddings": 5, "pad_token_id": 1}', '{"max_position_embeddings": -5, "pad_token_id": 1}'):
        with pytest.raises(decoding.ModelError):
            decoding.max_pieces(bad)
    for bad in ("{", "{}", '{"id2label": {"1": "a|b"}}', '{"id2label": {"0": "x"}}', '{"id2label": {"0": "X|_|goeswith"}}', '{"id2label": {"0": "_|_", "1": "X|_|goeswith", "2": "V|_|root"}}'):
        with pytest.raises(decoding.ModelError):
            decoding.Labels.from_config(bad)


def test_masked_rows():
    assert decoding.masked_rows(0, 2, 9, [5, 6], range(0, 2)).tolist() == [[0, 9, 6, 2, 5], [0, 5, 9, 2, 6]]


def test_graph_contract():
    from lectern.sources.model import check_graph

    good = {"input_ids": "tensor(int64)", "attention_mask": "tensor(int64)"}
    check_graph(good, {"logits": ("tensor(float)", ["a", "b", 6])}, 6)
    check_graph(good, {"logits": ("tensor(float)", ["a", "b", "c"])}, 6)
    for inputs, outputs in [({"input_ids": "tensor(int64)"}, {}), (good | {"x": "tensor(int64)"}, {}), (good, {}), (good, {"logits": ("tensor(double)", [])}), (good, {"logits": ("tensor(float)", [1, 2, 5])}), (good | {"input_ids": "tensor(int32)"}, {})]:
        with pytest.raises(decoding.ModelError):
            check_graph(inputs, outputs, 6)


def test_spark_syntax(spark):
    from pyspark.sql import functions as F

    from lectern.operators import syntax
    from lectern.sources.conllu import TOKENS

    parses = spark.createDataFrame(PARSES, f"sentence string, tokens {TOKENS}")
    s = spark.createDataFrame([(t,) for t, _ in PARSES] + [("Unknown.",)], "sentence string")
    out = {r.sentence: r for r in syntax.with_syntax(syntax.with_known_parses(s, parses)).withColumn("noms", syntax.nominalizations(F.col("parse.tokens"))).withColumn("heads", syntax.passive_heads(F.col("parse.tokens"))).collect()}
    assert out["Unknown."].parse.status == "unparsed" and out["Unknown."].syntax is None
    x = out[EMBEDDED[0]].syntax
    assert (x.distance, x.dependencies, x.depth, x.clauses, x.center_embeddings[0].words_between) == (32, 12, 4, 1, 8)
    assert out[NOMINAL[0]].noms == 3 and out[PASSIVE[0]].heads == [4, 13]
    assert [p.verb for p in out[PASSIVE[0]].syntax.passives] == ["written", "rejected"]


def test_conllu(spark):
    from pyspark.sql import functions as F

    from lectern.sources import conllu

    block = "# text = I can't\n1\tI\tI\tPRON\t_\t_\t2\tnsubj\t_\t_\n2-3\tcan't\t_\t_\t_\t_\t_\t_\t_\t_\n2\tcan\tcan\tAUX\t_\t_\t0\troot\t_\t_\n3\tnot\tnot\tPART\t_\t_\t2\tadvmod\t_\t_\n3.1\tx\tx\tX\t_\t_\t2\tdep\t_\t_"
    (r,) = spark.createDataFrame([(block + "\n\n" + block,)], "s string").select(F.explode(conllu.sentence_blocks(F.col("s"))).alias("b")).select(conllu.text(F.col("b")).alias("t"), conllu.tokens(F.col("b")).alias("k")).distinct().collect()
    assert r.t == "I can't" and [(t.id, t.form, t.head, t.deprel) for t in r.k] == [(1, "I", 2, "nsubj"), (2, "can", 0, "root"), (3, "not", 2, "advmod")]
