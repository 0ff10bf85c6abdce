import numpy as np
import xxhash

from lectern.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """{fp: smallest fp reached}"""
    left, out = set(fps), {}
    for f in sorted(fps):
        if f in out:
            continue
        todo, out[f] = [f], f
        while todo:
            x = todo.pop()
            for y in left:
                if y not in out and (x ^ y).bit_count() <= 2:
                    out[y] = f
                    todo.append(y)
    return out


def expected(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    comp = slow_components({f for _, f in fps})
    low = {}
    for i, f in fps:
        low[comp[f]] = min(low.get(comp[f], i), i)
    return sorted((i, f, low[comp[f]]) for i, f in fps)


def got(df):
    return sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in df.collect())


def test_fingerprints_and_components_match_brute_force(spark, sample):
    rows = list(sample.items())
    assert got(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_odd_rows(odd):
    from tests.llm.conftest import ODD

    assert got(simhash.near_duplicates(odd)) == expected(ODD)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_links_find_every_class(spark):
    """Chains, cliques and strangers, in whole and in split buckets, whatever the bucket bound."""
    rng = np.random.default_rng(1)
    fps = {0}
    for base in rng.integers(0, 2**63, 30):
        x = int(base)
        for _ in range(20):
            fps.add(x)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                x ^= 1 << int(b)
    near = int(rng.integers(0, 2**63))
    fps |= {near ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (400, 3))}
    want = slow_components(fps)
    unique = spark.createDataFrame([(f if f < 2**63 else f - 2**64,) for f in fps], "fp long")
    from lectern.llm.common import components

    for bucket in (5, 1000):
        edges = simhash.links(unique, bucket).cache()
        assert all(((r.u % 2**64) ^ (r.v % 2**64)).bit_count() < 64 for r in edges.collect())
        by = {}
        for r in components(edges).collect():
            by.setdefault(r.component, set()).add(r.node % 2**64)
        classes = {}
        for f, c in want.items():
            classes.setdefault(c, set()).add(f)
        assert sorted(map(sorted, by.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_pivot_filter_loses_no_link():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fp[150:] = fp[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    i, j = np.triu_indices(300, 1)
    table = np.bitwise_count(fp[:, None] ^ simhash.pivots()[None, :]).astype(np.int8)
    a, b = simhash.linked(fp, i, j, table)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= 2
    assert set(zip(a.tolist(), b.tolist())) == set(zip(i[near].tolist(), j[near].tolist()))


def test_candidates_are_near_and_leave_out_none_within_sure_bits(spark):
    """In whole and in split buckets; nodes of one fingerprint are a star."""
    rng = np.random.default_rng(3)
    fps = []
    for base in rng.integers(0, 2**63, 40):
        for _ in range(25):
            fps.append(int(base))
            for b in rng.integers(0, 64, int(rng.integers(0, 8))):
                fps[-1] ^= 1 << int(b)
    rows = spark.createDataFrame([(i, f if f < 2**63 else f - 2**64) for i, f in enumerate(fps)], "node long, fp long")
    near = {i for i, f in enumerate(fps) if any(i != j and (f ^ g).bit_count() <= simhash.SURE for j, g in enumerate(fps))}
    assert len({*fps}) < len(fps) and len(near) > 500
    for bucket in (5, 1000):
        found = [(r.u, r.v) for r in simhash.candidates(rows, bucket).collect()]
        assert len(found) == len({*found}) and all(u < v and (fps[u] ^ fps[v]).bit_count() <= simhash.NEAR for u, v in found)
        assert near <= {i for p in found for i in p}


def test_blocks_are_those_of_the_number(spark):
    fps = [0, -1, 2**63 - 1, -(2**63), 0x0123456789ABCDEF]
    for parts in (4, 6):
        which = simhash.shares(64, parts)
        assert sum(w for _, w in which) == 64
        for r in spark.createDataFrame([(f,) for f in fps], "fp long").select("fp", *[simhash.blocks(simhash.F.col("fp"), [which[a], which[b]]) for a, b in simhash.combinations(range(parts), 2)]).collect():
            want = [((r.fp % 2**64 >> a & (1 << m) - 1) << n) + (r.fp % 2**64 >> b & (1 << n) - 1) for (a, m), (b, n) in simhash.combinations(which, 2)]
            assert list(r[1:]) == want
