import random

import numpy as np
import pytest
import xxhash

from tallybrook.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius or rows[i][0] == rows[j][0]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min(least.get(c, d), d)
    return sorted((d, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp))


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdEÉ") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.choice((3, 40, 400)))) for _ in range(60)]
    for k in range(60):
        own = texts[k].split(" ")
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = word()
        texts.append("\t\n ".join(own))
    return [(k * 3, t) for k, t in enumerate(texts)] + [(7, ""), (8, " \n"), (9, "One"), (10, "one")]


def test_fingerprint_of_odd_texts():
    for _, text in corpus()[:80]:
        assert S.fingerprint(text) == brute_fingerprint(text)
    for text in ("", " ", "A b", "É É É É É", "x" * 100_000, "a\xa0b c\x1cd e f", "K" * 3 + " İ I"):
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component int").repartition(3)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    assert got == brute_components(rows)


@pytest.fixture
def split(monkeypatch):
    """Every key that a few rows share is split off in joins and dealt as a grid."""
    for name, value in (("LEAST_SPLIT", 1), ("GRID_ROWS", 3), ("GRID_CHARS", 2000), ("GRID_TEXTS", 7), ("SPLIT", 10**9)):
        monkeypatch.setattr(S, name, value)


def test_split_keys_give_the_same_groups(spark, split):
    rows = corpus() + [(500 + k, "the same text in many rows " * 3) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    assert got == brute_components(rows)


def brute_groups(rows, words=5, similarity=0.8):
    sets = [set(S.shingle_set(t or "", words).tolist()) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        least[c] = min(least.get(c, d), d)
    return {d: least[c] for (d, _), c in zip(rows, comp)}


def chains():
    """Chains of near texts, each like the next alone, and a large group of texts that are like one."""
    rng, rows = random.Random(21), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for k in range(6):
        text = [word() for _ in range(120)]
        for n in range(12):
            rows.append((100 * k + n, " ".join(text)))
            text = list(text)
            text[9 * n + 5] = word()
    base = [word() for _ in range(100)]
    for n in range(60):
        own = list(base)
        own[rng.randrange(100)] = word()
        rows.append((1000 + n, " ".join(own)))
    return rows


def test_similar_groups_against_brute_force(spark):
    rows = chains()
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_split_groups_are_the_same(spark, split):
    rows = chains() + [(2000, ""), (2001, None)] + [(2100 + k, "one text in very many rows of the table " * 2) for k in range(30)]
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_every_close_pair_is_linked(spark, blocks, monkeypatch):
    monkeypatch.setattr(S, "blocks_for", lambda rows, radius: blocks)
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(12):
            for bit in rng.choice(63, rng.integers(1, 9), replace=False).tolist():
                b ^= 1 << bit
            values.add(b)
    values = sorted(values)
    codes = spark.createDataFrame(list(enumerate(values)), "id long, fp long")
    found = {r.id: r.component for r in S.components(S.links(codes, 4, len(values))).collect()}
    comp = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin((values[i] ^ values[j]) & (2**64 - 1)).count("1") <= 4:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert [found.get(k, k) for k in range(len(values))] == comp


def test_bit_slices_agree_with_counting():
    rng = np.random.default_rng(0)
    near = (np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    values = np.r_[near, rng.integers(0, 2**63, 57).astype(np.uint64), near[:70]]
    planes = S.bit_planes(values)
    for by in (1, 63, 64, 65, 200):
        wanted = np.zeros(len(values), bool)
        wanted[: len(values) - by] = True
        found = np.unpackbits(S.close_pairs(planes, S._flag_words(wanted), by, 4).view(np.uint8), bitorder="little")[: len(values)]
        far = np.bitwise_count(values[:-by] ^ values[by:])
        assert (found[: len(values) - by] == (far <= 4)).all() and not found[len(values) - by :].any()


def test_wide_fingerprints_and_counters():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2**63, (500, 8)).astype(np.uint64)
    x[250:] = x[:250] ^ (np.uint64(1) << rng.integers(0, 64, (250, 8)).astype(np.uint64))
    for radius in (3, 8, 86, 260):
        wanted = np.zeros(500, bool)
        wanted[:250] = True
        found = np.unpackbits(S.close_pairs(S.bit_planes(x), S._flag_words(wanted), 250, radius).view(np.uint8), bitorder="little")[:250]
        assert (found == (np.bitwise_count(x[:250] ^ x[250:]).sum(1) <= radius)).all()
    rng, word = random.Random(9), lambda: f"w{rng.randrange(10**6)}"
    a = [word() for _ in range(400)]
    for edits in (5, 15, 60):
        b = list(a)
        for k in rng.sample(range(400), edits):
            b[k] = word()
        s, t = ({tuple(v[i : i + 5]) for i in range(396)} for v in (a, b))
        exact = S.agreement(len(s & t) / len(s | t))
        far = np.bitwise_count(S.wide_fingerprint(" ".join(a), 5, 64) ^ S.wide_fingerprint(" ".join(b), 5, 64)).sum() / 4096
        assert abs(1 - far - exact) < 0.03


def test_similar_groups(spark):
    rng, rows = random.Random(12), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for k in range(150):
        base = [word() for _ in range(rng.choice((60, 300)))]
        rows.append((10 * k, " ".join(base)))
        rows.append((10 * k + 1, " ".join(base).upper()))
        near, far = list(base), list(base)
        near[len(base) // 2] = word()  # five shingles of the text's differ
        for i in range(0, len(base), 4):
            far[i] = word()
        rows += [(10 * k + 2, " ".join(near)), (10 * k + 3, " ".join(far))]
    rows += [(5001, ""), (5002, None), (5003, "short text"), (5004, "Short text"), (5005, "other text")]
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * k] == got[10 * k + 1] == 10 * k and got[10 * k + 3] == 10 * k + 3 for k in range(150))
    assert sum(got[10 * k + 2] == 10 * k for k in range(150)) >= 149
    assert [got[k] for k in range(5001, 5006)] == [5001, 5001, 5003, 5003, 5005]


def test_similar_groups_leave_texts_below_the_similarity_apart(spark):
    rng, rows, want = random.Random(3), [], {}
    word = lambda: f"w{rng.randrange(10**6)}"
    for k in range(200):
        base = [word() for _ in range(rng.choice((10, 44, 104)))]
        other = [*base[:-1], word()] if len(base) == 10 else list(base)  # ten words: 5 of 7 shingles are shared
        for n in range(0 if len(base) == 10 else len(base) // 30):
            other[12 + 30 * n] = word()
        s, t = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (base, other))
        want[2 * k + 1] = 2 * k if len(s & t) / len(s | t) >= 0.8 else 2 * k + 1
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    assert all(k == v for k, v in want.items())
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want


def test_shingles_and_their_sets_against_plain_ones(monkeypatch):
    import re

    monkeypatch.setattr(S, "_PIECE", 50)
    rng = random.Random(21)
    words = ["a", "B", "cc", "É", "漢字", "\u00a0x", "word", "WORD", "z" * 70, "\ud800"]
    texts = ["", " ", "\t\n", "one", " one  two\x0bthree "] + [rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randrange(60))) for _ in range(300)]
    plain = {}
    for text in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        for k in (4, 5):
            want = [" ".join(own[i : i + k]) for i in range(max(1, len(own) - k + 1))] if own else []
            data, starts, ends = S.shingles(text, k)
            assert [data[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts, ends)] == want
            got = S.shingle_set(text, k)
            assert len(got) == len(set(want))
        for h, w in zip(S.word_hashes(text).tolist(), own, strict=True):
            assert plain.setdefault(h, w) == w
    assert len(plain) == len(set(plain.values()))


def test_a_text_repeated_under_one_id(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    near = [*base[:50], "other", *base[51:]]
    rows = [(None, " ".join(base))] * 3000 + [(7, " ".join(near))] * 500 + [(8, "apart from them all")]
    got = S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "component_id").count().collect()
    null = S.C.NULL_ID
    assert sorted((r.doc_id, r.component_id, r["count"]) for r in got) == [(null, null, 3000), (7, null, 500), (8, 8, 1)]


def test_lots_hold_every_bucket():
    for size in (1, 7, 60_000, 60_001):
        for rows in (60_000, 120_000, 59_999):
            e = np.array([*range(size, rows, size), rows])
            cuts = S.lots(e)
            assert cuts[0] == 0 and cuts[-1] == len(e) and (np.diff(cuts) >= 0).all()


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a b c d e"), (2, "p q r s t u"), (3, "P Q r s t u"), (3, "P Q r s t u")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id) for r in S.near_duplicates(df).collect())
    assert got == [(0, None), (1, None), (2, 2), (2, 2), (3, 2), (3, 2)]
    assert S.near_duplicates(df.where("false")).collect() == []


def test_chain_and_star(spark):
    pairs = [(k + 1, k) for k in range(60)] + [(1000, k) for k in range(100, 160)]
    got = {r.id: r.component for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got) == {*range(1, 61), *range(101, 160), 1000} and all(v == (0 if k <= 60 else 100) for k, v in got.items())


def test_random_keys_have_few_rows_however_many_there_are():
    """Keys of 10 bits served 4 million rows, so a key's comparisons grew with the square of the rows."""
    for rows in (1000, 60_000, 235_000, 2_800_000, 14_000_000):
        bits, tables = S.bands(rows, 0.8)
        assert rows / 2**bits <= S.KEY_ROWS
        assert (1 - S.agreement(0.8) ** bits) ** tables <= 0.004


def test_keys_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "KEY_ROWS", 0.02)
    rows = [(k, " ".join(f"w{k // 3}x{j}" for j in range(60)) + f" end{k}") for k in range(90)]
    assert S.bands(len(rows), 0.8)[1] > 2 * S.ROUND - 20
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 3 for k in range(90)}
