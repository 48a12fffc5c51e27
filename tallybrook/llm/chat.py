"""Chat formatting by columnar byte assembly, and the way back.

A turn is `header + content + footer`, marked by control strings. Control strings that stand in a text (or in a role)
get a backslash after their first character, one more than they have, so the way back is to take one away.

A batch of turns is formatted at once: the lengths of its segments give their cumulative offsets, these the
indices from which and to which bytes are copied, and headers, contents and footers go into one preallocated Arrow
buffer. Rows are dealt by ranges of conversation and turn, so a conversation with very many turns spreads over tasks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C

#: role: header, what follows the role's name (in headers that hold one), footer. Any other role is written by name.
TEMPLATE = {"system": ("<<SYS>>\n", "", "\n<</SYS>>\n"), "user": ("[INST] ", "", " [/INST]"), "assistant": ("<s>", "", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "</s>")
#: Control strings, after their first character and any backslashes.
_CONTROLS = (("<", r"/?s>|</?SYS>>"), (r"\[", r"/?(?:INST|ROLE)\]"))
_ESCAPED = re.compile(r"(<)\\(\\*(?:/?s>|</?SYS>>))|(\[)\\(\\*/?(?:INST|ROLE)\])")
_TURN = re.compile(r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<name>.*?)\[/ROLE\](?P<other>.*?)</s>", re.S)

#: Bytes of formatted text in a row, unless one turn has more; bytes assembled at a time; a longer piece is copied by itself.
PART, LOT, LONG = 1 << 20, 32 << 20, 1 << 16
FORMATTED = "conv_id long, part long, n_turns int, text string, loss array<struct<start: int, end: int>>"


def escape(values: pa.Array) -> pa.Array:
    for first, rest in _CONTROLS:
        values = pc.replace_substring_regex(values, pattern=rf"({first})(\\*)({rest})", replacement=r"\1\\\2\3")
    return values


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text) if "\\" in text else text


def scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copies pieces source[starts : starts + lengths] to the places `at` of out."""
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[at[i] : at[i] + lengths[i]] = source[starts[i] : starts[i] + lengths[i]]
    short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    ends = np.cumsum(lengths[short])
    lots = np.unique(np.r_[np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, 1 << 22)), len(short)])
    for i, j in zip(lots[:-1].tolist(), lots[1:].tolist(), strict=True):
        own, n = short[i:j], lengths[short[i:j]]
        before = np.cumsum(n) - n
        within = np.arange(int(n.sum()))
        out[np.repeat(at[own] - before, n) + within] = source[np.repeat(starts[own] - before, n) + within]


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The data of a string array, and the start and length of each of its strings."""
    values = values.cast(pa.large_string())
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held, ends[:-1], np.diff(ends)


def _fixed(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [v.encode() for v in values]
    lengths = np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"".join(raw) or b"\0", np.uint8), np.cumsum(lengths) - lengths, lengths


class Assembler:
    """Formats batches of turns (conv_id, role, text) that are in order."""

    def __init__(self, loss_roles: tuple[str, ...]):
        self.names = list(TEMPLATE)
        kinds = [*TEMPLATE.values(), OTHER]
        self.fixed = [_fixed([k[n] for k in kinds]) for n in range(3)]
        self.loss_roles = pa.array(loss_roles, pa.string())

    def pieces(self, roles: pa.Array, texts: pa.Array):
        """Sources of the five pieces of each turn, and the turns whose content is under the loss mask."""
        roles = pc.fill_null(roles.cast(pa.string()), "")
        kind = pc.fill_null(pc.index_in(roles, pa.array(self.names)), len(self.names)).to_numpy(zero_copy_only=False).astype(np.int64)
        named = pa.array(kind < len(self.names))
        name = escape(pc.if_else(named, "", roles))
        content = escape(pc.fill_null(texts.cast(pa.string()), ""))
        head, after, foot = ((data, starts[kind], lengths[kind]) for data, starts, lengths in self.fixed)
        return [head, _bytes(name), after, _bytes(content), foot], pc.is_in(roles, self.loss_roles).to_numpy(zero_copy_only=False)

    def assemble(self, conv: np.ndarray, roles: pa.Array, texts: pa.Array, first_part: int):
        """Record batches of FORMATTED; parts are numbered from first_part."""
        sources, under_loss = self.pieces(roles, texts)
        size = np.stack([lengths for _, _, lengths in sources], axis=1)
        total = size.sum(1)
        run = np.r_[True, conv[1:] != conv[:-1]]
        before = np.cumsum(total) - total
        within = before - np.repeat(before[run], np.diff(np.r_[np.flatnonzero(run), len(conv)]))
        first = np.flatnonzero(run | np.r_[False, np.diff(within // PART) != 0])
        ends = np.r_[first[1:], len(conv)]
        lots = np.unique(np.r_[np.searchsorted(before[first], np.arange(0, int(total.sum()), LOT)), len(first)])
        for i, j in zip(lots[:-1].tolist(), lots[1:].tolist(), strict=True):
            rows = slice(int(first[i]), int(ends[j - 1]))
            yield self._batch(sources, size[rows], rows, under_loss[rows], conv, first[i:j], ends[i:j], first_part + i)

    def _batch(self, sources, size, rows, under_loss, conv, first, ends, number) -> pa.RecordBatch:
        at = (np.cumsum(size.ravel()) - size.ravel()).reshape(size.shape)
        total = int(size.sum())
        buffer = pa.allocate_buffer(total)
        out = np.frombuffer(memoryview(buffer), np.uint8)
        for k, (data, starts, lengths) in enumerate(sources):
            scatter(out, at[:, k], data, starts[rows], lengths[rows])
        opens = at[first - rows.start, 0]
        texts = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.r_[opens, total].astype(np.int64).tobytes()), buffer]).cast(pa.string())
        # The mask: the contents' places within their part.
        marked = np.flatnonzero(under_loss)
        part = np.searchsorted(first, marked + rows.start, side="right") - 1
        start = at[marked, 3] - opens[part]
        spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(start + size[marked, 3], pa.int32())], ["start", "end"])
        loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(part, np.arange(len(first) + 1)), pa.int32()), spans)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv[first]), pa.array(np.arange(number, number + len(first), dtype=np.int64)), pa.array(ends - first, pa.int32()), texts, loss], ["conv_id", "part", "n_turns", "text", "loss"]
        )


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, part, n_turns, text, loss of the conversations in rows (conv_id, turn, role, text).

    A conversation's text is that of its parts in ascending order; it has more than one only if it is longer than PART
    or lies where two tasks meet. `loss`: start and end, in UTF-8 bytes of the part, of each content of a loss role.
    Turns are in the order of `turn`, null first; ties by role, then by the text's hash and the text. A null text
    is empty, and so is a null role; rows without a conv_id are one conversation (C.NULL_ID here). Equal rows are turns of their
    own. Other columns are ignored; an empty table gives no rows.
    """
    n = C.sized(rows)
    own = rows.select(C.id_column("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    dealt = own.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("conv_id", "role", "text")

    def run(batches):
        tool = Assembler(loss_roles)
        context = TaskContext.get()
        part = context.partitionId() << 40  # ranges are numbered in order
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            conv = table.column("conv_id").to_numpy()
            last = int(np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])[-1])
            tail = table.slice(last)
            cut = table.num_rows if tail.nbytes > PART else last
            for out in _assembled(tool, table.slice(0, cut), part):
                part += out.num_rows
                yield out
            held = table.slice(cut).combine_chunks() if cut < table.num_rows else None
        if held is not None:
            yield from _assembled(tool, held, part)
        C.release()

    return dealt.mapInArrow(run, FORMATTED)


def _assembled(tool: Assembler, table: pa.Table, part: int):
    if table.num_rows:
        one = [pa.concat_arrays(table.column(c).cast(pa.large_string()).chunks) for c in ("role", "text")]
        yield from tool.assemble(table.column("conv_id").to_numpy(), _small(one[0]), _small(one[1]), part)


def _small(values: pa.Array) -> pa.Array:
    """As a plain string array, which holds up to 2 GB; a task's batches are far smaller."""
    return values.cast(pa.string())


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns in a formatted text."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        kind = m.lastgroup
        out.append((unescape(m["name"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
    if at != len(text):
        raise ValueError(f"no turn at {at}")
    return out


class _Digest:
    """What the parts of one conversation say, a part at a time."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, loss) -> None:
        own = turns_of(text)
        self.n_turns += len(own)
        self.chars += len(text)
        self.turns.update("".join([f"{r}\n{t}\n" for r, t in own]).encode())
        if len(loss):
            raw = text.encode()
            under = [unescape(raw[s["start"] : s["end"]].decode()) for s in loss]
            self.loss_chars += sum(map(len, under))
            self.loss.update("".join(under).encode())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_FOUND = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_DIGESTED = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, held_bytes: int = 8 << 20) -> DataFrame:
    """conv_id and digests of the turns, and of the text under the loss mask, read back from format_conversations().

    A conversation that lies within a task is digested there. The first and the last of a task may go on in others, and
    long ones (over held_bytes) are not held: their parts go through one exchange and stream through a digest in order,
    as a digest of a whole conversation must.
    """

    def own(batches):
        first, last, held, size = None, None, [], 0
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                if row.conv_id != last:
                    if held:  # it ended within this task
                        digest = _Digest()
                        for r in held:
                            digest.add(r.text, r.loss)
                        out.append((last, 0, *digest.row(), None, None))
                    last, held, size = row.conv_id, [], 0
                    first = last if first is None else first
                size += len(row.text)
                held.append(row)
                if last == first or size > held_bytes:
                    out += [(r.conv_id, r.part, None, None, None, None, None, r.text, r.loss) for r in held]
                    held = []
                    first = last if size > held_bytes and last != first else first
            yield pd.DataFrame(out, columns=["conv_id", "part", *_FOUND, "text", "loss"], dtype=object)
        yield pd.DataFrame([(r.conv_id, r.part, None, None, None, None, None, r.text, r.loss) for r in held], columns=["conv_id", "part", *_FOUND, "text", "loss"], dtype=object)

    def finish(batches):
        at, digest = None, None
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                if digest is not None and row.conv_id != at:
                    out.append((at, *digest.row()))
                    digest = None
                if row.text is None:
                    out.append((row.conv_id, row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256, row.formatted_chars))
                    continue
                at, digest = row.conv_id, digest or _Digest()
                digest.add(row.text, row.loss)
            yield pd.DataFrame(out, columns=["conv_id", *_FOUND]).astype({c: "Int64" for c in ("n_turns", "loss_chars", "formatted_chars")})
        if digest is not None:
            yield pd.DataFrame([(at, *digest.row())], columns=["conv_id", *_FOUND])

    spans = "array<struct<start: int, end: int>>"
    parts = formatted.mapInPandas(own, f"conv_id long, part long, {_DIGESTED}, text string, loss {spans}")
    done = parts.repartition(C.partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part").mapInPandas(finish, f"conv_id long, {_DIGESTED}")
    return done.withColumn("conv_id", F.when(F.col("conv_id") != C.NULL_ID, F.col("conv_id")))


def oracle_sql() -> str:
    """op11_chat_format in DuckDB's SQL, over `conversations`."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"

    held = "coalesce({}, '')"
    for first, rest in _CONTROLS:
        held = f"regexp_replace({held}, '({first})(\\\\*)({rest})', '\\1\\\\\\2\\3', 'g')"
    text, name = held.format("text"), held.format("role")
    fixed = " ".join(f"when {quoted(r)} then {sum(map(len, t))}" for r, t in TEMPLATE.items())
    return f"""
with rows as (
  select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' order by turn nulls first, role nulls first)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' order by turn nulls first) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({text}) + case role {fixed} else {sum(map(len, OTHER))} + length({name}) end) as bigint) as formatted_chars
from rows group by conv_id"""
