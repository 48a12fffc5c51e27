import hashlib
import random

import numpy as np

from tallybrook.llm import common as C
from tallybrook.llm.suffix_dedup import dedup_substrings, gram_hashes, without_repeats


def brute(rows, width):
    first = {}
    for d, raw in sorted(rows, key=lambda x: x[0]):
        for s in range(len(raw) - width + 1):
            k = raw[s : s + width]
            first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for d, raw in rows:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            if first[raw[s : s + width]] < (d, s):
                gone[s : s + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, width, frequent=2000):
    df = spark.createDataFrame(rows, "doc_id long, text string, b int").repartition(5)
    got = dedup_substrings(df, width, keep=None, frequent=frequent).collect()
    return sorted((C.NULL_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def check(spark, texts, width=100, frequent=2000):
    rows = list(texts.items()) if isinstance(texts, dict) else texts
    got = run(spark, [(d, t, 7) for d, t in rows], width, frequent)
    assert got == brute([(C.NULL_ID if d is None else d, (t or "").encode()) for d, t in rows], width)


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    lines = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = {}
    for d in range(140):
        parts = [rng.choice(lines) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 8))]
        texts[d] = " ".join(parts)
    for d in range(140, 190):
        base = list(texts[rng.randrange(140)])
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = "X"
        texts[d] = "".join(base)
    check(spark, texts)
    check(spark, texts, frequent=2)


def test_edges(spark):
    run_ = "a" * 1000
    rows = [(1, None), (2, ""), (3, run_), (4, "a" * 99), (5, "a" * 100), (6, "ab" * 400), (7, run_ + "b" + run_), (None, "a" * 100), (8, "é" * 80), (9, "é" * 80), (-3, "x" * 150)]
    check(spark, rows)


def test_repeated_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until the string is long enough to count, yes"
    got = run(spark, [(1, text, 0), (1, text, 0), (2, text, 0)], 100)
    assert [r[2] for r in got] == [0, 0, len(text)]


def test_repeated_rows_after_the_first_place(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until the string is long enough to count, yes"
    rows = [(9, text, 0), (9, text, 0), (9, text + " and more", 0), (2, text, 0), (None, "z" * 99, 0)]
    got = run(spark, rows, 100)
    assert [r[:3] for r in got] == [(C.NULL_ID, 99, 0), (2, len(text), 0), (9, len(text), len(text)), (9, len(text), len(text)), (9, len(text) + 9, len(text))]


def test_many_texts_of_one_id_and_without_id(spark):
    """More texts than 16 bits number: each keeps its own result."""
    end = "and the end of it is a passage of more than one hundred bytes that stands in just two of these many many texts"
    rows = spark.range(70_000).selectExpr("IF(id % 2 = 0, NULL, 7L) AS doc_id", f"IF(id IN (2, 69001), concat('{end}', id), concat('t', id)) AS text", "1 AS b")
    got = dedup_substrings(rows, 100, keep=None).where("n_bytes > 100").orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(None, 0), (7, len(end))]
    assert dedup_substrings(rows, 100, keep=None).where("n_removed > 0").count() == 1


def test_long_texts_go_in_parts(spark, monkeypatch):
    import tallybrook.llm.suffix_dedup as S

    rng = random.Random(11)
    texts = {d: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 3000))) for d in range(9)}
    texts[20] = "".join(texts[d] for d in range(9)) * 2
    raw = [(d, t.encode()) for d, t in texts.items()]
    monkeypatch.setattr(S, "_CHUNK", 500)
    assert list(S._chunks(np.array([len(x) for _, x in raw])))[-1][1] == len(raw)
    check(spark, texts)


def test_text_that_stays(spark):
    line = "".join(chr(0x100 + k) for k in range(60))
    rows = [(1, "a" + line, 5, None), (2, "b" + line + "ü", 6, [1]), (None, None, None, None), (3, "c" + line, 7, None), (3, "c" + line, 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `b` long, `odd name` array<int>")
    out = without_repeats(df)
    assert out.columns == [*df.columns, "n_removed"]
    got = sorted(out.collect(), key=lambda r: r.b or 0)
    assert [tuple(r) for r in got] == [(None, None, None, None, 0), (1, "a" + line, 5, None, 0), (2, "bü", 6, [1], 120), (3, "c", 7, None, 120), (3, "c", 8, None, 120)]
    assert {r.kept for r in dedup_substrings(df).where("doc_id = 2").collect()} == {"bü".encode()}


def test_halves_of_cut_characters_do_not_fuse(spark):
    """The repeat covers the second byte of one character and the first of another: both go."""
    middle = "x" * 98
    first = "\u0123" + middle + "\u0163"  # C4 A3 ... C5 A3
    second = "\u0163" + middle + "\u0141"  # C5 A3 ... C5 81
    df = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in without_repeats(df).collect()}
    assert got == {1: (first, 0), 2: ("", 100)}


def test_empty_table(spark):
    assert run(spark, [], 100) == []


def test_rolling_hash_depends_on_content_only():
    a = np.frombuffer(b"0123456789" * 9, np.uint8)
    h = gram_hashes(a)
    assert (h[:40] == h[10:50]).all() and len(set(h[:10].tolist())) == 10


def test_bucket_of_id_agrees_with_spark(spark):
    to = C.Buckets(7)
    ids = [0, 1, -5, 2**62, None, 123456789]
    got = [r.b for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(to.column().alias("b")).collect()]
    assert got == to.of_ids(np.array([C.NULL_ID if i is None else i for i in ids])).tolist()
    spread = spark.createDataFrame([(int(k),) for k in to.keys], "b int").repartition(7, "b").rdd.glom().map(len).collect()
    assert spread == [1] * 7
