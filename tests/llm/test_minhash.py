import random

import numpy as np
from tests.llm.helpers import ODD, documents, frame, shingles, wide

from voxelith.llm.minhash import M, estimate, keep_representatives, merge, near_duplicates, sketch


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for j, (_, s) in enumerate(sets):
        for e in s:
            by.setdefault(e, []).append(j)
    seen = set()
    for js in by.values():
        for a in js:
            for b in js:
                if a < b:
                    seen.add((a, b))
    for a, b in seen:
        (x, p), (y, q) = sets[a], sets[b]
        if 100 * len(p & q) >= percent * len(p | q):
            r, s = root(x), root(y)
            parent[max(r, s)] = min(r, s)
    return {i: root(i) for i, _ in sets}


def check(spark, rows, df=None):
    got = near_duplicates(df if df is not None else frame(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((i or -1, len(shingles(t))) for i, t in rows)


def test_documents(spark):
    d = documents()
    check(spark, list(zip(d.doc_id.tolist(), d.text.tolist())))


def test_odd_rows_and_clashing_names(spark):
    check(spark, ODD)
    check(spark, ODD, wide(spark))
    assert near_duplicates(frame(spark, [])).count() == 0


def test_chain_of_variants(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(120):
        rows.append((1000 - i, " ".join(words)))
        words = words[:]
        words[rng.randrange(200)] = f"v{i}"
    for i in range(60):
        rows.append((2000 + i, " ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(3, 40)))))
    check(spark, rows)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(e[:2000]), np.sort(e[500:])
    one = lambda x: sketch(x, np.array([0, len(x)]))
    assert (merge(one(a), one(b)) == one(np.sort(e))).all() and one(a).shape == (1, M)
    assert abs(estimate(one(a), one(b), np.array([2000.0]), np.array([2500.0]))[0] - 0.5) < 0.15


def test_one_of_each_group_stays(spark):
    kept = [r.doc_id for r in keep_representatives(frame(spark)).collect()]
    assert 9 in kept and 10 not in kept and None in kept


def test_many_copies_that_are_not_linked_to_their_pivot(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = base[:]
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(120)
            w[at] = f"e{at % 12}" if rng.random() < 0.5 else f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    check(spark, rows)
