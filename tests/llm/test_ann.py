import numpy as np

from tallybrook.llm import ann as A


def brute(ids, x, k=20, every=20):
    out = []
    for i, q in zip(ids, x):
        if i % every:
            continue
        s = A.exact(x, q)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out += [(int(i), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[::7] *= 3
    x[100:140] = x[100]  # ties
    ids = rng.permutation(9000)[:3000]
    df = frame(spark, [(int(i), v.tolist(), 1) for i, v in zip(ids, x)]).repartition(4)
    for block_rows in (None, 700):
        got = A.search(df, df.where("vec_id % 20 = 0"), block_rows=block_rows).collect()
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
        want = brute(ids, x)
        assert set(got) == {(q, r) for q, r, _, _ in want}
        same = sum(got[q, r] == (v, s) for q, r, v, s in want)
        assert same / len(want) > 0.98


def test_clusters_are_skipped_without_loss(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 32)) * 4
    x = (centres[rng.integers(0, 12, 3000)] + 0.2 * rng.standard_normal((3000, 32))).astype(np.float32)
    x[500:1500] = x[500]  # a third of all rows is one vector
    ids = np.arange(3000)
    df = frame(spark, [(int(i), v.tolist(), 1) for i, v in zip(ids, x)]).repartition(4)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in A.search(df, df.where("vec_id % 20 = 0"), block_rows=250).collect()}
    want = brute(ids, x)
    assert set(got) == {(q, r) for q, r, _, _ in want}
    assert sum(got[q, r][1] == s for q, r, _, s in want) / len(want) > 0.98
    cells = A.Cells({32: A.kmeans(x.astype(float), 12)})
    own, far = cells.nearest(list(x.astype(float)))
    cells.count([(c, int((own == c).sum()), float(far[own == c].max())) for c in np.unique(own).tolist()], {32: 250})
    visited = []
    for i in range(0, 3000, 100):
        q = x[i].astype(float)
        score = np.sort(x @ q)[-20]
        blocks = cells.worth(q, score)
        visited.append(len(blocks) / cells.blocks)
        best = {int(cells.block(own[j], 0)) for j in np.flatnonzero(A.exact(x, q) >= score)}
        assert best <= set(blocks.tolist())
    assert np.mean(visited) < 0.5


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 128))
    block = A.Block(np.arange(4000), x)
    for _ in range(20):
        q = rng.standard_normal(128)
        (estimate,), (error,) = block.bounds(q[None, :])
        assert (np.abs(estimate - block.vectors @ q) <= error).mean() > 0.97


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (0, v, 1), (20, None, 1), (40, [0.0, 0.0, 0.0], 1), (60, [], 1), (1, [1.0, None, 2.0], 1), (2, [float("nan"), 1.0, 1.0], 1), (3, [float("inf"), 1.0, 1.0], 1), (None, v, 1), (5, v, 1), (5, v, 1), (4, v, 1), (80, [-1.0, 0.0, 0.0], 1), (9, [1.0, 1.0], 1)]
    df = frame(spark, rows)
    got = [tuple(r) for r in A.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4, 14.0), (0, 2, 5, 14.0), (0, 3, 5, 14.0), (0, 4, 80, -1.0), (80, 1, 0, -1.0), (80, 2, 0, -1.0), (80, 3, 4, -1.0), (80, 4, 5, -1.0), (80, 5, 5, -1.0)]
    assert A.search(df.where("false"), df).collect() == [] and A.search(df, df.where("false")).collect() == []
