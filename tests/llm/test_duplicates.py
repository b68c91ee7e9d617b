import random

import numpy as np

from tests.llm import brute
from tests.llm.conftest import prose
from tidemark.llm import graph, minhash


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None}


def check(spark, pairs, size=4):
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    want = brute.duplicates(pairs, size)
    assert found(minhash.near_duplicates(df, size)) == {k: (n, c, c == k) for k, (n, c) in want.items()}


def test_copies_and_chains(spark):
    rng = random.Random(3)
    base = prose(rng, 200, "abcdefghijklmnop").split()
    pairs = [(50, " ".join(base)), (7, " ".join(base).upper())]
    now = list(base)
    for k in range(40):  # a chain: neighbours are alike, its ends aren't
        now[4 * k % 200] = f"z{k}"
        pairs.append((100 + k, " ".join(now)))
    for k in range(60):  # a star: alike to the base, less to each other
        own = list(base)
        for i in rng.sample(range(200), 6):
            own[i] = f"q{k}x{i}"
        pairs.append((300 + k, " ".join(own)))
    pairs += [(500 + k, " ".join(base[:60]) + " " + prose(rng, 60)) for k in range(30)]  # a shared passage
    pairs += [(600, ""), (601, None), (602, "a"), (603, "a"), (604, "a b"), (605, " \n")]
    check(spark, pairs)


def test_edges(docs, rows):
    rest = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) > 1}
    got = found(minhash.near_duplicates(docs, 5))
    want = brute.duplicates([(k, t) for k, t, *_ in rows if k is not None and k not in rest], 5)
    for k, (n, c) in want.items():
        assert got[k][0] == n
        if c not in rest and got[k][1] not in rest:
            assert got[k][1] == c, k
    # document 3 has two texts: it ties the copies of both together
    assert got[0][1] == got[1][1] == got[3][1] == got[900][1] == 0
    nulls = [r for r in minhash.near_duplicates(docs, 5).collect() if r.doc_id is None]
    assert len(nulls) == 3 and all(r.component_id is None and r.kept for r in nulls)


def test_nothing(none):
    assert minhash.near_duplicates(none, 5).collect() == []


def test_sketch_estimates():
    rng = np.random.default_rng(4)
    for n in (1, 3, 30, 400, 5_000):
        both = rng.integers(0, 1 << 63, 4 * n, dtype=np.uint64)
        a, b = np.unique(both[: 3 * n]), np.unique(both[n:])
        x, y = minhash.sketch(a), minhash.sketch(b)
        assert x.max() < np.iinfo(np.uint64).max
        assert abs((x == y).mean() - 0.5) < 0.2 or n < 3
        assert (minhash.sketch(a[::-1].copy()) == x).all()


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(60)] + [(999, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def top(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(df).df.collect()}
    assert got == {a: top(a) for a in parent if top(a) != a}


def test_links_at_the_threshold_are_found(spark):
    """Pairs at a similarity of 0.80 to 0.82, exactly counted: all are linked."""
    rng, pairs = random.Random(11), []
    for k in range(250):
        base = [f"p{k}w{i}" for i in range(200)]
        own = list(base)
        while True:
            a, b = brute.shingles(" ".join(base), 4), brute.shingles(" ".join(own), 4)
            both = len(a & b)
            if 100 * both < 82 * (len(a) + len(b) - both):
                break
            own[rng.randrange(200)] = f"p{k}x{rng.random()}"
        if 100 * both >= 80 * (len(a) + len(b) - both):
            pairs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    assert len(pairs) > 200
    got = found(minhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 4))
    assert all(got[k][1] == k - k % 2 for k, _ in pairs)
