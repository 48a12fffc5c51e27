"""Draws from strata: the same rows as sorting each stratum, without doing that."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import sampling, studies

SCHEMA = "review_id string, grp string, kind string, text string, ord long"


def made(n=3000):
    rng = random.Random(11)
    return [(f"r{k}", rng.choice(["a"] * 20 + ["b", "c", None]), rng.choice("xy"), "word " * rng.randrange(1, 60), k) for k in range(n)]


def key(seed, i):
    return hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i


def sorted_draw(rows, strata, want, seed):
    groups = {}
    for r in rows:
        groups.setdefault(strata(r), []).append(r)
    return sorted(r[0] for g, own in groups.items() for r in sorted(own, key=lambda r: key(seed, r[0]))[: want.get(g, 0) if isinstance(want, dict) else want])


@pytest.mark.parametrize("want", [1, 7, 200, 5000])
def test_a_number_for_each_stratum(spark, want):
    rows = made()
    got = sampling.drawn(spark.createDataFrame(rows, SCHEMA).repartition(5), ["grp", "kind"], want, 3)
    assert sorted(r.review_id for r in got.collect()) == sorted_draw(rows, lambda r: (r[1], r[2]), want, 3)


def test_a_table_of_numbers(spark):
    rows, want = made(), {"a": 30, "c": 2, None: 5, "d": 4}
    table = spark.createDataFrame(list(want.items()), "grp string, want long")
    got = sampling.drawn(spark.createDataFrame(rows, SCHEMA), ["grp"], table, 4)
    assert sorted(r.review_id for r in got.collect()) == sorted_draw(rows, lambda r: r[1], want, 4)


def test_a_bound_that_is_too_low_is_made_good(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_ALL", 16**13)  # bounds 256 times too low
    rows = made()
    got = sampling.drawn(spark.createDataFrame(rows, SCHEMA), ["grp"], 40, 5)
    assert sorted(r.review_id for r in got.collect()) == sorted_draw(rows, lambda r: r[1], 40, 5)


def test_few_rows_of_a_stratum_travel(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("review_id"), F.lit("one").alias("grp"))
    near = []
    kept = sampling.materialise
    try:
        sampling.materialise = lambda df, what: near.append(kept(df, what)) or near[-1]
        assert sampling.drawn(rows, ["grp"], 50, 1).count() == 50
    finally:
        sampling.materialise = kept
    assert near[0].count() < 200


def test_empty_rows(spark):
    assert sampling.drawn(spark.createDataFrame([], SCHEMA), ["grp"], 3, 1).collect() == []


def test_next_slice_equals_a_ranking_of_all(spark):
    rng = random.Random(3)
    rows = [(f"r{k}", "good bad " * rng.randrange(4) + "some words here", k) for k in range(600)]
    seen = [(f"r{k}",) for k in rng.sample(range(600), 350)]
    df = spark.createDataFrame(rows, "review_id string, text string, ord long").repartition(4)
    scores = {"g": F.regexp_count("text", F.lit("good")), "b": F.regexp_count("text", F.lit("bad")) - 1, "n": F.lit(0)}
    got = studies.next_slice(df, scores, 25, spark.createDataFrame(seen, "review_id string"), skip=40)
    want = []
    for name, score in (("g", lambda t: t.count("good")), ("b", lambda t: t.count("bad") - 1)):
        ranked = sorted(((-score(t), k, i) for i, t, k in rows if score(t) > 0))
        fresh = [(name, n + 1, i, -h) for n, (h, _, i) in enumerate(ranked) if n >= 40 and (i,) not in seen]
        want += fresh[:25]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    few = studies.next_slice(df, scores, 500, spark.createDataFrame([], "review_id string"), skip=0)
    assert few.where("intent = 'g'").count() == sum("good" in t for _, t, _ in rows)
