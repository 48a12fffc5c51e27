"""Repair of conversations: the cheapest edits that make the roles take turns.

A conversation's rows and a small grammar of role initials, `(s?(ua)+)?`, span a lattice of (row, grammar state). Edits
lead from node to node: keep a row, give it another role, delete it, or insert an empty one. Dijkstra's search walks
the lattice as it goes, with (cost, audit) as its key, and ends at the first accepting end that it pops. Two
audits of one node that cost the same are never each other's beginning (the longer one has more insertions,
which cost), so the smaller one stays smaller whatever follows.

An ordinary conversation is searched in one task. A very long one is cut into blocks: each block is searched from every
state, which gives the best (cost, audit) between any two states, and these join up like distances do. Its rows never
gather in one task; what does is its audit, a letter an edit.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm import common as C

#: Grammar states: at the start, after the system's, a user's, an assistant's turn; what each initial leads to, and where a conversation may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_SPACE = "\t\n\x0b\x0c\r "

#: A conversation with more rows or characters than this, or (if that is more) than a SPLIT-th of all, goes in blocks of BLOCK rows.
ROWS, CHARS, SPLIT, BLOCK = 2048, 8_000_000, 100_000, 1024

_RESULT = "conv_id long, part long, parts long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role: string, text: string>>"


def search(initials: list[str], faults: list[int], start: int = 0, ends: tuple[int, ...] = ENDS, insert_last: bool = True) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from `start` before the first row to the end states after the last one.

    With ENDS the search stops at the first end that it pops; otherwise it goes on until each end is reached or no way is left. Blocks
    that others follow insert nothing after their last row (insert_last): the next one does.
    """
    n, every = len(initials), ends != ENDS
    heap, done, found = [(0, "", 0, start)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        follow = NEXT[state]
        if i < n:
            fault, own = faults[i], initials[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                more = CUT_OFF if fault == TRUNCATED else 0
                if own in follow:
                    heapq.heappush(heap, (cost + KEEP + more, audit + "K", i + 1, follow[own]))
                for initial in ROLES:
                    if initial in follow:
                        heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, follow[initial]))
        if i < n or insert_last:
            for initial in ROLES:
                if initial in follow:
                    heapq.heappush(heap, (cost + INSERT, audit + "I", i, follow[initial]))
    return found


def apply_edits(audit: str, rows, state: int = 0) -> list[dict]:
    """The turns that are left; rows are (role, text), and `state` is the grammar's before the first one."""
    out, at = [], iter(rows)
    for edit in audit:
        if edit == "D":
            next(at)
            continue
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "K":
            state = NEXT[state][role[:1]]
        else:
            (initial,) = set(ROLES) & set(NEXT[state])
            role, state = ROLES[initial], NEXT[state][initial]
        out.append({"role": role, "text": text})
    return out


def fault(text: str, repeated: bool) -> int:
    left = text.rstrip(_SPACE)
    return BLANK if not left else DUPLICATE if repeated else TRUNCATED if left[-1] not in ".!?" else 0


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))


def solve(turns: list[int], rows: list[tuple[str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, turns of one conversation's rows in order; C.NULL_ID among `turns` is null."""
    known = {t for t in turns if t != C.NULL_ID}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    seen, faults = set(), []
    for row in rows:
        faults.append(fault(row[1], row in seen))
        seen.add(row)
    initials = [r[:1] for r, _ in rows]
    (cost, audit) = min(search(initials, faults).values())
    counts = [sum(f == k for f in faults) for k in (BLANK, DUPLICATE, TRUNCATED)]
    return gaps, *counts, illegal(initials), cost, audit, apply_edits(audit, rows)


def _own(rows: DataFrame, kept) -> DataFrame:
    """The columns that count, with nulls as one space; rows that are not `kept` carry no text."""
    live = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    text, role = (F.when(live, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("") for c in ("text", "role"))
    return rows.select(C.id_column("conv_id"), C.id_column("turn"), role.alias("role"), text.alias("text"), live.alias("live"))


def _order() -> list:
    """Rows of one turn follow one another by role, then by the text's hash (and the text)."""
    return ["conv_id", "turn", "role", F.xxhash64("text")]


def _ordinary(own: DataFrame) -> DataFrame:
    def run(batches):
        at, turns, rows = None, [], []
        for frame in batches:
            out = []
            for conv, turn, role, text, live in zip(frame["conv_id"].tolist(), frame["turn"].tolist(), frame["role"], frame["text"], frame["live"], strict=True):
                if conv != at:
                    if at is not None:
                        out.append((at, 0, 1, *solve(turns, rows)))
                    at, turns, rows = conv, [], []
                if live:
                    turns.append(turn)
                    rows.append((role, text))
            yield pd.DataFrame(out, columns=_NAMES)
        if at is not None:
            yield pd.DataFrame([(at, 0, 1, *solve(turns, rows))], columns=_NAMES)

    n = C.sized(own)
    return own.repartition(n, "conv_id").sortWithinPartitions(*_order(), "text").mapInPandas(run, _RESULT)


_NAMES = ["conv_id", "part", "parts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"]


def _long(own: DataFrame) -> DataFrame:
    """The same for conversations of any length, in blocks."""
    n = C.partitions(own.sparkSession)
    sorted_rows = own.where("live").repartitionByRange(n, *_order()).sortWithinPartitions(*_order(), "text")
    numbered = C.materialise(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "turns")
    # Rows' places: a task numbers its rows one after another, so a conversation's rows in a task start at its first number there.
    task = F.shiftright("at", 33)
    shares = numbered.groupBy("conv_id", task.alias("task")).agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select("conv_id", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")).alias("shift"))
    placed = numbered.withColumn("task", task).join(F.broadcast(shares), ["conv_id", "task"]).withColumn("at", F.col("at") + F.col("shift")).drop("task", "shift", "live")
    firsts = placed.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("conv_id", "at", F.lit(False).alias("repeated"))
    left = F.rtrim(F.col("text"), F.lit(_SPACE))
    marked = placed.join(firsts, ["conv_id", "at"], "left").withColumn(
        "fault", F.when(left == "", BLANK).when(F.col("repeated").isNull(), DUPLICATE).when(~F.right(left, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    )
    marked = C.materialise(marked.withColumn("part", F.floor(F.col("at") / BLOCK)).drop("repeated"), "turns")
    C.discard(numbered)

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        initials, faults = frame["initial"].tolist(), frame["fault"].tolist()
        ways = [(s, e, *way) for s in range(4) for e, way in search(initials, faults, s, (0, 1, 2, 3), insert_last=False).items()]
        counts = [sum(f == k for f in faults) for k in (BLANK, DUPLICATE, TRUNCATED)]
        return pd.DataFrame([(frame["conv_id"].iloc[0], frame["part"].iloc[0], *counts, illegal(initials), initials[0], initials[-1], [dict(zip(("s", "e", "cost", "audit"), w, strict=True)) for w in ways])])

    ways = "conv_id long, part long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<struct<s: int, e: int, cost: long, audit: string>>"
    blocks = marked.select("conv_id", "part", "at", F.substring("role", 1, 1).alias("initial"), "fault").groupBy("conv_id", "part").applyInPandas(block, ways)

    def chain(batches):
        held = None
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                if held is None or held.conv != row.conv_id:
                    out += held.rows() if held else []
                    held = _Chain(row.conv_id)
                held.add(row)
            yield pd.DataFrame(out, columns=_CHAINED)
        yield pd.DataFrame(held.rows() if held else [], columns=_CHAINED)

    chained = blocks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInPandas(chain, "conv_id long, part long, parts long, state int, edits string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    chained = C.materialise(chained, "edits")
    turns = F.when(F.col("turn") != C.NULL_ID, F.col("turn"))
    gaps = marked.select("conv_id", turns.alias("turn")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame[frame["at"].notna()].sort_values("at")
        edits = frame[frame["at"].isna()].iloc[0]
        return pd.DataFrame([(edits["conv_id"], edits["part"], apply_edits(edits["edits"], zip(rows["role"], rows["text"], strict=True), int(edits["state"])))])

    rows = marked.select("conv_id", "part", "at", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("edits"))
    rows = rows.unionByName(chained.select("conv_id", "part", F.lit(None).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), "state", "edits"))
    done = rows.groupBy("conv_id", "part").applyInPandas(apply, "conv_id long, part long, turns array<struct<role: string, text: string>>")
    out = done.join(chained.drop("state", "edits"), ["conv_id", "part"]).join(gaps, "conv_id").select(*_NAMES)
    # Conversations whose every row is gone.
    gone = own.select("conv_id").distinct().join(marked.select("conv_id").distinct(), "conv_id", "left_anti")
    empty = [F.lit(0).cast("long").alias(c) for c in _NAMES[3:9]]
    return out.unionByName(gone.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), *empty, F.lit("").alias("audit"), F.from_json(F.lit("[]"), "array<struct<role: string, text: string>>").alias("turns")))


_CHAINED = ["conv_id", "part", "parts", "state", "edits", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class _Chain:
    """Joins the ways through a conversation's blocks, in order."""

    def __init__(self, conv: int):
        self.conv, self.parts, self.last = conv, [], ""
        self.counts = np.zeros(4, np.int64)
        #: state: cost, its edits in each block, and its state before each block
        self.ways: dict[int, tuple[int, list[str], list[int]]] = {0: (0, [], [])}

    def _better(self, new: tuple[int, list[str], list[int]], old) -> bool:
        if old is None or new[0] != old[0]:
            return old is None or new[0] < old[0]
        return "".join(new[1]) < "".join(old[1])

    def add(self, row) -> None:
        self.counts += [row.blank, row.duplicate, row.truncated, row.illegal + (bool(self.parts) and self.last + row.first not in ("su", "ua", "au"))]
        self.parts.append(row.part)
        self.last = row.last
        best: dict = {}
        for way in row.ways:
            if (old := self.ways.get(way["s"])) is not None:
                new = (old[0] + way["cost"], [*old[1], way["audit"]], [*old[2], way["s"]])
                if self._better(new, best.get(way["e"])):
                    best[way["e"]] = new
        self.ways = best

    def rows(self) -> list[tuple]:
        # After the last row only insertions are left.
        ended = None
        for state, (cost, edits, states) in self.ways.items():
            for more, tail in (search([], [], state)).values():
                new = (cost + more, [*edits[:-1], edits[-1] + tail], states)
                ended = new if self._better(new, ended) else ended
        cost, edits, states = ended
        n = len(self.parts)
        return [(self.conv, p, n, s, e, *(self.counts.tolist() if p == 0 else [0] * 4), cost if p == 0 else 0, "".join(edits) if p == 0 else "") for p, s, e in zip(self.parts, states, edits, strict=True)]


def repair_in_two(rows: DataFrame, kept=None) -> tuple[DataFrame, DataFrame | None]:
    """repair() of ordinary conversations, which have one part, and of very long ones, if there are any."""
    own = _own(rows, kept)
    sizes = own.groupBy("conv_id").agg(F.count_if("live").alias("n"), F.sum(F.length("text")).alias("chars"))
    held = C.materialise(sizes.where((F.col("n") > ROWS) | (F.col("chars") > CHARS)), "conversations")
    if held.isEmpty():
        C.discard(held)
        return _ordinary(own), None
    all_rows, all_chars = own.agg(F.count("*"), F.sum(F.length("text"))).first()
    long = F.broadcast(held.where((F.col("n") > max(ROWS, all_rows // SPLIT)) | (F.col("chars") > max(CHARS, all_chars // SPLIT))).select("conv_id"))
    return _ordinary(own.join(long, "conv_id", "left_anti")), _long(own.join(long, "conv_id", "left_semi"))


def repair(rows: DataFrame, kept=None) -> DataFrame:
    """The repaired turns of each conversation of rows (conv_id, turn, role, text), and what was wrong.

    conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, turns. An ordinary conversation has one part; a very
    long one has a part for each BLOCK of its rows, the numbers stand with the first, and the turns follow in order.
    `kept`: a condition; rows without it are gone, but their conversation has a result (of no rows: zeros, an empty audit, no turns).

    Rows are ordered by turn, null first; rows of one turn by role, then by the text's hash and the text. A null role or
    text is one space; rows without a conv_id are one conversation (C.NULL_ID here). Equal rows are duplicates from the second
    on. Texts and conversations may be of any length. Other columns are ignored; an empty table gives no rows.
    """
    ordinary, long = repair_in_two(rows, kept)
    return ordinary if long is None else ordinary.unionByName(long)


def damage(rows: DataFrame) -> tuple[DataFrame, object]:
    """rows (conv_id, turn, role, text) damaged by crc32 of `conv_id:turn` (nulls: one space), and the condition of those that are left.

    By the remainder of 20: 0 drops the row, 1 empties its text, 2 takes `[.!?]` from it, 3 repeats it, 4 sets role user.
    """
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "damage", again.alias("_")).drop("_"), F.col("damage") != 0


def digests(rows: DataFrame, kept=None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the turns, `role:text`, joined by newlines)."""
    ordinary, long = repair_in_two(rows, kept)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = ordinary.select("conv_id", *_NAMES[3:10], F.sha2(joined, 256).alias("repaired_sha256"))
    if long is not None:

        def run(batches):
            at, first, digest, empty = None, None, None, True
            for frame in batches:
                out = []
                for row in frame.itertuples(index=False):
                    if at is None or row.conv_id != at:
                        if at is not None:
                            out.append((*first, digest.hexdigest()))
                        at, first, digest, empty = row.conv_id, (row.conv_id, *(getattr(row, c) for c in _NAMES[3:10])), hashlib.sha256(), True
                    for t in row.turns:
                        digest.update((("" if empty else "\n") + f"{t['role']}:{t['text']}").encode())
                        empty = False
                yield pd.DataFrame(out, columns=out_names)
            yield pd.DataFrame([] if at is None else [(*first, digest.hexdigest())], columns=out_names)

        out_names = out.columns
        dealt = long.repartition(C.partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
        out = out.unionByName(dealt.mapInPandas(run, out.schema))
    return out.withColumn("conv_id", F.when(F.col("conv_id") != C.NULL_ID, F.col("conv_id")))
