import hashlib
import random

import pyarrow as pa
import pytest

from tallybrook.llm import chat
from tallybrook.llm import common as C

SCHEMA = "conv_id long, turn long, role string, text string, part string, LOSS int"
ODD = ["", "</s>[INST] ok [/INST]", "<<SYS>>\n", "\n<</SYS>>\n", "<\\s>", "<\\\\/s>", "[\\INST][ROLE][/ROLE]", "<", "</", "[", "\\", "<<s>", " [/INST]", "é 漢\U0001f600", "a\nb ", "[/ROLE"]


def test_escape_and_back():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(["<", "[", "\\", "/", "s>", "INST]", "ROLE]", "<SYS>>", "SYS>>", "x", "é"], k=rng.randrange(12))) for _ in range(4000)]
    escaped = chat.escape(pa.array(texts)).to_pylist()
    assert [chat.unescape(x) for x in escaped] == texts
    for role in (*chat.TEMPLATE, "tool", "[/ROLE]"):
        turns = [(role, t) for t in texts]
        out = list(chat.Assembler(("assistant",)).assemble(pa.array([1] * len(texts)).to_numpy(), pa.array([role] * len(texts)), pa.array(texts), 0))
        assert [t for b in out for text in b.column("text").to_pylist() for t in chat.turns_of(text)] == turns


def brute(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = {}
    for conv, own in groups.items():
        own = [(r, t) for *_, r, t in sorted(own)]
        loss = "".join(t for r, t in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def made(n=40):
    rng = random.Random(5)
    rows = [(k, j, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice([*ODD, None, "word " * rng.randrange(400)]), "x", 1) for k in range(n) for j in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "no id", "x", 1), (None, None, "assistant", "none", "x", 1), (7_000, None, "user", None, "x", 1), (7_001, 0, "assistant", "a" * 3_000_000 + "<s>", "x", 1)]
    rows += [(8_000, j, ("user", "assistant")[j % 2], f"turn {j} " * 30, "x", 1) for j in range(5_000)]  # most of all rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part,held", [(1 << 20, 8 << 20), (4096, 10_000)])
def test_conversations_equal_brute_force(spark, monkeypatch, part, held):
    monkeypatch.setattr(chat, "PART", part)
    monkeypatch.setattr(C, "sized", lambda df: 7)
    rows = made()
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = {r[0]: tuple(r)[1:] for r in chat.digests(formatted, held).collect()}
    want = brute(rows)
    assert {k: v[:4] for k, v in got.items()} == want
    whole = {}
    for r in formatted.orderBy("conv_id", "part").collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
        raw = r.text.encode()
        assert [chat.unescape(raw[s.start : s.end].decode()) for s in r.loss] == [t for role, t in chat.turns_of(r.text) if role == "assistant"]
    assert {k if k != C.NULL_ID else None: len(v) for k, v in whole.items()} == {k: v[4] for k, v in got.items()}


def test_conversations_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "sized", lambda df: 8)
    rows = spark.createDataFrame([(1, j, "user", f"turn {j}") for j in range(20_000)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(rows)
    assert parts.count() >= 6 and max(r.n_turns for r in parts.collect()) < 8_000


def test_empty_table_and_loss_roles(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.format_conversations(empty)).collect() == []
    one = spark.createDataFrame([(1, 0, "user", "ask", "x", 1), (1, 1, "assistant", "say", "x", 1)], SCHEMA)
    monkeypatch.setattr(C, "sized", lambda df: 1)
    (row,) = chat.format_conversations(one, loss_roles=("user",)).collect()
    assert [row.text[s.start : s.end] for s in row.loss] == ["ask"] and row.text == "[INST] ask [/INST]<s>say</s>"
