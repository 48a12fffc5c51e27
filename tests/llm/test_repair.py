import hashlib
import itertools
import random
import zlib

from tallybrook.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, cost string, Audit int"
SPACE = " \t\n\x0b\x0c\r"


def plain_search(initials, faults):
    """All ways through the lattice, by layers: no heap, and every (cost, audit) of a node is kept that may win."""
    best = {0: (0, "")}

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for s, (c, a) in list(ways.items()):
                for x in "ua":
                    if x in R.NEXT[s]:
                        new, to = (c + 3, a + "I"), R.NEXT[s][x]
                        ways[to] = min(ways.get(to, new), new)
        return ways

    for x, f in zip(initials, faults):
        after = {}
        for s, (c, a) in inserted(best).items():
            options = [(s, c + 4, "D")]
            if f not in (1, 2):
                extra = 3 if f == 3 else 0
                options += [(R.NEXT[s][x], c + extra, "K")] if x in R.NEXT[s] else []
                options += [(R.NEXT[s][y], c + 3 + extra, "R") for y in "ua" if y in R.NEXT[s]]
            for to, cost, letter in options:
                new = (cost, a + letter)
                after[to] = min(after.get(to, new), new)
        best = after
    return min(way for s, way in inserted(best).items() if s in R.ENDS)


def every_edit(initials, faults, most=3):
    """The cheapest audit by trying every string of edits, with `most` insertions at most."""
    best = None
    for letters in itertools.product("DKR", repeat=len(initials)):
        if any(f in (1, 2) and e != "D" for e, f in zip(letters, faults)):
            continue
        for n in range(most + 1):
            for places in itertools.combinations_with_replacement(range(len(initials) + 1), n):
                audit = "".join("I" * places.count(k) + e for k, e in enumerate(letters)) + "I" * places.count(len(initials))
                cost = 3 * n + sum({"D": 4, "K": 0, "R": 3}[e] + (3 if f == 3 and e != "D" else 0) for e, f in zip(letters, faults))
                if (best is None or (cost, audit) < best) and accepted(audit, initials):
                    best = (cost, audit)
    return best


def accepted(audit, initials):
    state, at = 0, iter(initials)
    for e in audit:
        x = next(at) if e != "I" else None
        if e == "D":
            continue
        if e == "K":
            if x not in R.NEXT[state]:
                return False
            state = R.NEXT[state][x]
        else:
            y = [c for c in "ua" if c in R.NEXT[state]]
            state = R.NEXT[state][y[0]]
    return state in R.ENDS


def brute(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = groups.setdefault(conv, [])
        if d == 0:
            continue
        text = "" if d == 1 else text.translate({ord(c): None for c in ".!?"}) if d == 2 else text
        own += [(turn is not None, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        known = {r[1] for r in own if r[0]}
        seen, faults = set(), []
        for _, _, role, text in own:
            left = text.rstrip(SPACE)
            faults.append(1 if not left else 2 if (role, text) in seen else 3 if left[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        cost, audit = plain_search(initials, faults)
        repaired, state, at = [], 0, iter(own)
        for e in audit:
            row = next(at) if e != "I" else None
            if e == "D":
                continue
            role = row[2] if e == "K" else "assistant" if state == 2 else "user"
            state = R.NEXT[state][role[:1]]
            repaired.append(f"{role}:{row[3] if row else ''}")
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(k) for k in (1, 2, 3)), R.illegal(initials), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0]))


def made():
    rng = random.Random(2)
    texts = ["Yes.", "No!", "Is it?", "cut off", "", " \t", None, "one. two", "more words here.\n", "x ", "end. ", "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    rows = [(k, t, rng.choice(roles), f"{t} {rng.choice(texts)}" if rng.random() < 0.5 else rng.choice(texts), "x", 1) for k in range(150) for t in rng.sample(range(20), rng.randrange(1, 10))]
    rows += [(None, None, "user", "Hello.", "x", 1), (None, 3, "assistant", "Hi.", "x", 1), (900, None, "user", "a.", "x", 1)]
    rows += [(901, 2**40, "user", "word " * 300_000, "x", 1), (901, 2**40 + 5, "assistant", "Fine.", "x", 1)]
    return rows


def test_search_equals_every_edit():
    rng = random.Random(1)
    for _ in range(120):
        n = rng.randrange(5)
        initials, faults = [rng.choice("suax") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        want = every_edit(initials, faults)
        (got,) = R.search(initials, faults).values()
        assert got == want == plain_search(initials, faults)


def test_search_equals_layers_on_long_rows():
    rng = random.Random(4)
    for n in (30, 200):
        initials, faults = [rng.choice("suaax") for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        (got,) = R.search(initials, faults).values()
        assert got == plain_search(initials, faults)


def test_damaged_conversations_equal_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert rows_of(R.digests(*R.damage(df))) == brute(rows)


def test_long_conversations_go_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = made() + [(5_000, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"text {t}.", f"text {t}", "again.", ""]), "x", 1) for t in range(0, 1_500, 2)]
    rows += [(5_001, t, "user", "same.", "x", 1) for t in range(80)]
    gone = next(t for t in range(1000) if zlib.crc32(f"6000:{t}".encode()) % 20 == 0)
    rows += [(6_000, gone, "user", "dropped " * 50, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows)
    assert rows_of(R.digests(*R.damage(df))) == want
    monkeypatch.setattr(R, "ROWS", 4)
    monkeypatch.setattr(R, "BLOCK", 5)
    monkeypatch.setattr(R, "SPLIT", 10**9)
    damaged, kept = R.damage(df)
    assert rows_of(R.digests(damaged, kept)) == want
    parts = R.repair(damaged, kept).where("conv_id = 5000").orderBy("part").collect()
    assert len(parts) > 100 and all(len(p.turns) < 20 for p in parts) and [p.part for p in parts] == list(range(len(parts)))


def test_empty_table_and_conversation_without_rows(spark):
    assert R.digests(*R.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = R.digests(*R.damage(spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 1)], SCHEMA))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
