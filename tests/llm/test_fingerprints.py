import hashlib
import random

import numpy as np

from tallybrook.llm import fingerprints as S


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéABß") for _ in range(rng.randint(1, 6)))
    return [(k, " ".join(word() for _ in range(rng.choice((0, 1, 4, 30, 300, 3000))))) for k in rng.sample(range(-50, 5000), 150)]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, k int").repartition(4)
    return S.compare_with_next(df).collect()


def test_against_direct_sets(spark):
    rows = sorted(corpus())
    got = {r.doc_id: r for r in run(spark, rows)}
    assert len(got) == len(rows)
    errors = []
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == S.to_text(S.fingerprint(text)) and r.edited_fingerprint == S.to_text(S.fingerprint(changed))
        a, b, c = shingles(text), shingles(changed), shingles(after)
        exact = len(a & b) / len(a | b) if a | b else 1.0
        errors.append(abs(r.near_edited - exact))
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1.0)) < 0.05
        if len(a | b) <= S.LEAST:
            assert abs(r.near_edited - exact) < 1e-12
    assert np.mean(errors) < 0.04 and max(errors) < 0.3


def test_odd_rows(spark):
    long = "word " * 40_000
    rows = [(None, "null id"), (1, None), (2, ""), (3, "same text here"), (3, "same text here"), (3, "another under three"), (9, long)]
    got = sorted(run(spark, rows), key=lambda r: (r.doc_id if r.doc_id is not None else -9, r.n_chars))
    assert len(got) == 7 and sum(r.near_next == 1.0 for r in got if r.doc_id == 3) == 1
    assert [r.n_chars for r in got] == [7, 0, 0, 14, 14, 19, 200_000]
    assert run(spark, []) == []
    (one,) = run(spark, [(5, "only one row of text in here")])
    assert one.near_next == 1.0


def test_an_id_that_most_rows_have(spark):
    """Rows without an id are read in several ranges, each followed by its next row."""
    rows = [(None if k % 3 else k, f"text number {k} " * (k % 5 + 1)) for k in range(400)]
    got = run(spark, rows)
    assert len(got) == 400 and sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)
    h = {r.text: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], h[x[1]], x[1]))
    want = []
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want.append((-1 if d is None else d, hashlib.sha256(changed.encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.edited_sha256) for r in got) == sorted(want)
    assert len(set(S.Ranges([7, 7, 7, 9]).of(np.full(100, 7), np.arange(100, dtype=np.int64) * 10**17 * 9 - 4 * 10**18).tolist())) == 3


def test_sketches_merge():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (3, 20, 300, 5000)]
    for a in sets:
        for b in sets:
            assert (S.merge(S.sketch(a), S.sketch(b)) == S.sketch(np.union1d(a, b))).all()
    small, large = sets[2], np.union1d(sets[2], sets[3])
    assert S.containment(S.sketch(small), S.sketch(large)) == 1.0
    assert abs(S.containment(S.sketch(large), S.sketch(small)) - 300 / 5300) < 0.03
    assert (S.from_text(S.to_text(small)) == small).all()
