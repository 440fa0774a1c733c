import numpy as np
import pandas as pd

from voxelith.llm.topk import Block, top_k

SF = "/root/testdata/sf0.01"


def brute(ids, vecs, k=20):
    v = np.floor(64 * vecs.astype(float)).astype(np.int64)
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        c = [(-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i]]
        out += [(ids[i], r + 1, j, -x) for r, (x, j) in enumerate(sorted(c)[:k])]
    return sorted(out)


def test_whole_table(spark):
    t = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = sorted(tuple(r) for r in top_k(rows, rows.where("vec_id % 20 = 0")).collect())
    assert got == brute(t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()))


def test_search_in_rounds_is_exact():
    rng = np.random.default_rng(1)
    v = rng.integers(-30, 30, (3000, 16))
    v[:200] = v[0]
    ids = rng.permutation(3000)
    i, j, s = Block(ids, v).search(ids[:40], v[:40], 20)
    for q in range(40):
        score = v @ v[q]
        want = sorted((-score[x], ids[x]) for x in range(3000) if x != q)[:20]
        assert sorted(zip((-s[i == q]).tolist(), ids[j[i == q]].tolist())) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (20, [0.1, -0.2]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (40, None), (6, [1.0, 0.5]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as d")
    got = top_k(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 6), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 6)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_search_is_exact_for_large_components():
    rng = np.random.default_rng(5)
    v = np.concatenate([np.full((2000, 1), 100_000), rng.integers(0, 2, (2000, 40))], axis=1)
    q = np.concatenate([np.full((20, 1), 100_000), rng.integers(100, 900, (20, 40))], axis=1)  # sums of 1e10, told apart by hundreds
    ids = rng.permutation(2000)
    i, j, s = Block(ids, v).search(np.full(20, -1), q, 20)
    for n in range(20):
        score = v @ q[n]
        assert sorted(zip((-s[i == n]).tolist(), ids[j[i == n]].tolist())) == sorted(zip((-score).tolist(), ids.tolist()))[:20]


def test_queries_stop_before_the_last_step_where_that_is_proven():
    rng = np.random.default_rng(6)
    v = (rng.standard_normal((4000, 24)) * np.array([400.0] + [4.0] * 23)).astype(np.int64)  # one dimension decides
    block = Block(np.arange(4000), v)
    i, j, s = block.search(np.arange(10), v[:10], 20)
    assert block.processed < 0.9 * 10 * block.used.sum()
    for n in range(10):
        score = v @ v[n]
        assert sorted(zip((-s[i == n]).tolist(), j[i == n].tolist())) == sorted((-score[x], x) for x in range(4000) if x != n)[:20]


def test_many_blocks_on_both_sides_give_what_one_gives(spark, monkeypatch):
    from voxelith.llm import topk

    monkeypatch.setattr(topk, "INDEX_ROWS", 70)
    monkeypatch.setattr(topk, "QUERY_ROWS", 9)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=(600, 7)), 2)
    v[100:300] = v[100]  # a large group of copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = top_k(df, df.where("vec_id % 20 = 0")).collect()
    whole = np.floor(64 * v).astype(int)
    for n in range(0, 600, 20):
        want = sorted((-int(whole[n] @ whole[c]), c) for c in range(600) if c != n)[:20]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == n), key=lambda r: r["rank"])] == want
