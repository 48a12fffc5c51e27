import math

import numpy as np
import pytest

from tallybrook.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, Score string"


def brute(rows):
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if y is not None and v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in own]
    out = set()
    for i, v, y in own:
        if i % 100:
            continue
        scored = sorted({(-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, z) for j, w, z in own})
        same = [(j, -s) for s, j, z in scored if z == y and j != i][:5]
        for p, ps in same:
            fit = [(j, -s) for s, j, z in scored if z != y and 30 * ps <= -100 * s <= 90 * ps][:10]
            out |= {(i, p, r + 1, j, ps, s) for r, (j, s) in enumerate(fit)}
    return sorted(out)


def mined(spark, rows, **how):
    df = N.usable(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5))
    from pyspark.sql import functions as F

    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(r) for r in N.mine(df, df.where("vec_id % 100 = 0"), **how).collect())


def vectors(n, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(dims)
    return [(int(i), (centre + rng.standard_normal(dims)).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in rng.permutation(n * 3)[:n]]


@pytest.mark.parametrize("anchors", [N.ANCHORS, 4])
def test_equals_brute_force(spark, monkeypatch, anchors):
    monkeypatch.setattr(N, "ANCHORS", anchors)
    monkeypatch.setattr(N, "ROWS", 128)
    monkeypatch.setattr(N, "COLUMNS", 3)
    rows = vectors(700)
    rows += [(9000 + k, rows[0][1], 3) for k in range(60)]  # ties
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [1.0], 1), (200, [], 1), (300, None, 1), (400, [1.0, None], 1), (500, [float("nan"), 1.0], 1), (600, [float("inf")], 1), (None, [1.0], 1)]
    rows += [(1, [1.0, 2.0, 3.0], 1), (2, [0.5, 1.0], 4), (3, [0.6, 0.7], 4), (3, [0.6, 0.7], 4), (4, [0.4], None), (7, [0.5, 0.5], 0), (14, [0.5, 0.5], 1), (0, [1.0, 2.0], 1), (5, [-1.0, -1.0], 1)]
    rows += [(0, [2.0, 2.0], 1), (1, [1.0, 2.0, 3.0], 1)]
    got = mined(spark, rows)
    assert got == brute(rows) and got


def test_scores_beyond_float64_are_exact(spark):
    big = 2.0**26
    rows = [(0, [big, 1.5], 1), (1, [big, 2.5], 1), (2, [big * 0.5, 0.25], 2), (3, [big * 0.5, 0.3], 2), (100, [1e30, 1.0], 1), (4, [1e30, 1e30], 3)]
    assert mined(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 2)]) == []
