import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybrook.operators import titles as T
from tallybrook.plans import registry


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def strings(rng, n, signs="abc1", longest=14):
    return ["".join(rng.choices(signs, k=rng.randrange(longest))) for _ in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.text("abc01", max_size=80), st.lists(st.text("abc01", max_size=300), min_size=1, max_size=8))
def test_bounds_hold_and_the_best_is_found(name, keys):
    block = T.TitleBlock(keys, list(range(len(keys))))
    for bound, key in zip(block.bounds(name).tolist(), keys, strict=True):
        assert ratio(name, key) <= bound
    top, at, _ = block.best(name)
    assert (top, -at) == max((ratio(name, key), -i) for i, key in enumerate(keys))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc01", max_size=80), max_size=9), st.lists(st.text("abc01", max_size=300), min_size=1, max_size=30, unique=True), st.integers(1, 4), st.booleans())
def test_many_names_in_a_trie_find_what_one_does(names, keys, beam, wide):
    block = T.TitleBlock(keys, [7 * k % 31 for k in range(len(keys))])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "_BEAM", beam)
        patch.setattr(T, "_LOT", 4)
        patch.setattr(T, "_WIDE", 1 << 18 if wide else 8)
        assert [x[:2] for x in block.best_of_all(names)] == [block.best(x)[:2] for x in names]


def test_matching_blocks_are_those_of_the_library():
    rng = random.Random(8)
    names, keys = ([x for x in strings(rng, 200, "ab01", n) if x] for n in (63, 190))
    block = T.TitleBlock(keys, list(range(len(keys))))
    own, title = (np.array([rng.randrange(len(x)) for _ in range(2000)]) for x in (names, keys))
    got = block._ratios(names, T._masks(names)[0], own, title)
    assert got.tolist() == [ratio(names[i], keys[j]) for i, j in zip(own.tolist(), title.tolist(), strict=True)]


def test_most_titles_are_left_out_by_their_prefixes():
    """Each name met each title before, at 20 and more microseconds a pair."""
    keys = [f"supplier{k:09d}" for k in range(0, 60000, 3)]
    names = [f"largering{k}" for k in range(0, 1200000, 12007)]
    block, visited = T.TitleBlock(keys, list(range(len(keys)))), 0
    bitwise_count = np.bitwise_count

    def counted(x):
        nonlocal visited
        visited += x.size
        return bitwise_count(x)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T.np, "bitwise_count", counted)
        found = block.best_of_all(names)
    assert visited < len(names) * len(keys) / 5
    assert [x[:2] for x in found[::20]] == [block.best(x)[:2] for x in names[::20]]


def test_prefixes_whose_late_characters_are_met_promise_less():
    """Signs left below a prefix meet characters at the end of the name: where these are met already, they add none. Some 1850 nodes a name before."""
    keys = [f"supplier{k:09d}" for k in range(60000)]
    names = [f"hotgear{k}" for k in range(0, 1200000, 12007)]
    block, met = T.TitleBlock(keys, list(range(len(keys)))), []
    repeat = np.repeat

    def counted(x, n):
        out = repeat(x, n)
        met.append(out.size if out.dtype == np.uint64 else 0)  # the open characters of each pair of name and node
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T.np, "repeat", counted)
        found = block.best_of_all(names)
    assert sum(met) < 1000 * len(names)
    assert [x[:2] for x in found[::20]] == [block.best(x)[:2] for x in names[::20]]


@pytest.mark.parametrize("chars", [1280, 20])
def test_grid_of_several_parts(spark, monkeypatch, chars):
    monkeypatch.setattr(T, "_CHARS", chars)
    rng = random.Random(6)
    titles, names = sorted(set(strings(rng, 150))), sorted(set(strings(rng, 90)))
    frames = spark.createDataFrame([(x,) for x in names], "name_key string"), spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title_key string, ord long")
    best = {}
    for r in T._best_in_grid(*frames, 7).collect():
        best[r.name_key] = max(best.get(r.name_key, (-1.0, 0)), (r.ratio, -r.ord))
    assert best == {x: max((ratio(x, t), -i) for i, t in enumerate(titles)) for x in names}


def test_each_cell_of_the_grid_is_a_task(spark, monkeypatch):
    """Cells were dealt by a hash, so some tasks had several and others none; and 360,000 titles were five parts."""
    rng = random.Random(6)
    titles, names = sorted(set(strings(rng, 150))), sorted(set(strings(rng, 90)))
    names = spark.createDataFrame([(x,) for x in names], "name_key string").localCheckpoint()
    many = spark.range(360000).selectExpr("concat('supplier', lpad(id, 9, '0')) AS title_key", "id AS ord")
    assert T._best_in_grid(names, many, 1000).rdd.getNumPartitions() == 1
    monkeypatch.setattr(T, "_CHARS", 20)
    best = T._best_in_grid(names, spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title_key string, ord long"), 7)
    rows, cells = -(-names.count() // 7), best.rdd.getNumPartitions()
    cell = [T.F.pmod(T.F.xxhash64(key), T.F.lit(n)).alias(key) for key, n in (("name_key", rows), ("title_key", cells // rows))]
    found = {tuple(r) for r in best.select(T.F.spark_partition_id(), *cell).collect()}
    assert cells % rows == 0 and len(found) > cells / 2 and len({p for p, _, _ in found}) == len(found)


@pytest.mark.parametrize("split", [4096, 3])
def test_near_titles_are_found_by_their_bigrams(spark, monkeypatch, split):
    """Every pair at the threshold, short and long, with repeated bigrams; and bigrams of many titles in parts."""
    monkeypatch.setattr(T, "_SPLIT", split)
    rng = random.Random(3)
    names = {x for x in strings(rng, 60) + strings(rng, 25, "ab", 40) + strings(rng, 10, "a", 30) if len(x) >= T.SHORTEST}
    changed = {x[:i] + rng.choice(["", "z", x[i : i + 1] * 2]) + x[i + 1 :] for x in names for i in rng.sample(range(len(x)), 3)}
    titles = changed | set(strings(rng, 60)) | {"a" * 300, ""}
    got = {tuple(r) for r in T.near_pairs(spark.createDataFrame([(x,) for x in names], "name_key string"), spark.createDataFrame([(x,) for x in titles], "title_key string")).collect()}
    want = {(a, b) for a in names for b in titles if ratio(a, b) >= T.NEAR}
    assert len(want) > 100 and want <= got


def test_names_whose_bigrams_many_titles_have_go_to_the_grid(spark, monkeypatch):
    """Numbers at the end of names met most numbered titles before, so 60,000 titles and 1.2 million names did not end."""
    near_pairs, met = T.near_pairs, []

    def counted(*args):
        met.append(near_pairs(*args).count())
        return near_pairs(*args)

    monkeypatch.setattr(T, "near_pairs", counted)
    titles = [f"supplier{k:09d}" for k in range(4000)]
    names = [f"hotgear{k}" for k in range(1100000, 1200000, 500)] + ["supplier00000012x"]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, ord int")
    found = {r.name: (r.title, r.ratio) for r in T.most_similar_titles(spark.createDataFrame([(x,) for x in names], "name string"), rows).collect()}
    assert met[0] <= 16 * len(names) and len(found) == len(names)
    for name in [*names[::40], names[-1]]:
        top, place = max((ratio(name, t), -i) for i, t in enumerate(titles))
        assert found[name] == (titles[-place], top)


def test_ratios_of_near_pairs_are_those_of_the_library():
    rng = random.Random(9)
    rows = [("".join(rng.choices("ab01", k=rng.choice([0, 5, 20, 63, 64, 90]))), "".join(rng.choices("ab01", k=rng.choice([0, 7, 30, 199, 200, 250])))) for _ in range(400)]
    a, b = (T.pd.Series(x) for x in zip(*rows, strict=True))
    assert T._ratio(a, b).tolist() == [ratio(*x) for x in rows]


def test_equal_to_all_pairs(spark):
    rng = random.Random(5)
    titles = strings(rng, 80) + ["Plan World: Money!", "plan-world money", "x" * 400, "", "ab" * 50]
    names = strings(rng, 60) + ["Plan World Money", "plan wrld money", "ab" * 45, "ab" * 31, "", "x", "x"]
    clean = lambda x: "".join(c for c in x.lower() if c.isalnum())
    want = []
    for name in names:
        top, place = max((ratio(clean(name), clean(t)), -i) for i, t in enumerate(titles))
        want.append((name, titles[-place], top))
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "title string, ord int")
    found = T.most_similar_titles(spark.createDataFrame([(x,) for x in names], "name string"), rows, block=7)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_no_nested_loop(spark):
    plan = registry.title_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
