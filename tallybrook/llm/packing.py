"""Best-fit packing of token sequences, by hierarchical residual packing.

Each task packs the pieces it has, largest first, each into the bin with the least room that takes it.
Bins that are nearly full are final. All others go on as items of their fill: eight tasks' bins meet in one
task and are packed again, and so on up a tree. A level has so many tasks that each gets about eight times
`carry` bins at most, dealt anew by hash, so no task's input grows with the corpus. The tree ends in one task
or, where the open bins are too many for one, when a round of dealing has closed or merged few of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C
from tallybrook.llm import tokens as T

FAN_IN = 8
#: Pieces that a task packs at a time.
TASK_PIECES = 1_000_000
_PIECE = np.dtype([("doc_id", "<i8"), ("piece", "<u4"), ("start", "<u8"), ("length", "<u4"), ("crc", "<u4")])
_BIN = "final boolean, bin long, fill int, pieces binary"
_ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: largest item first, into the bin with the least room that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r exists
    order = np.argsort(-sizes, kind="stable")
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = capacity, len(bins)
            bins.append([k])
        room -= size
        if room:
            by_room[room].append(at)
            rooms |= 1 << room
    return bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only a longer one is cut, and only its first piece may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _packed(sizes: np.ndarray, members: list[bytes], capacity: int, nearly: int, level: int) -> pd.DataFrame:
    bins = best_fit(sizes, capacity)
    fill = np.array([int(sizes[b].sum()) for b in bins], np.int32)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    final = fill >= nearly
    number = (np.int64(level) << 57) | (np.int64(part) << 30) | np.arange(len(bins), dtype=np.int64)
    return pd.DataFrame({"final": final, "bin": number, "fill": fill, "pieces": [b"".join(members[k] for k in b) for b in bins]})


def _local(capacity: int, nearly: int):
    def run(batches):
        unpack, sizes, members, held = zstandard.ZstdDecompressor(), [], [], 0
        for frame in batches:
            for d, n, raw in zip(C.ids(frame["doc_id"]).tolist(), frame["n"].tolist(), frame["ids"], strict=True):
                ids = T.unplanes(unpack.decompress(raw)).tobytes()
                for k, (s, size) in enumerate(cut(n, capacity)):
                    sizes.append(size)
                    members.append(np.array((d, k, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)])), _PIECE).tobytes())
            if len(sizes) > TASK_PIECES:  # a task of any length runs in bounded memory
                out = _packed(np.array(sizes), members, capacity, nearly, 0)
                out["bin"] += held
                held += len(out)
                sizes, members = [], []
                yield out
        if sizes:
            out = _packed(np.array(sizes), members, capacity, nearly, 0)
            out["bin"] += held
            yield out

    return run


def _again(capacity: int, nearly: int, level: int, last: bool):
    def run(batches):
        frame = C.whole(batches)
        if frame is None or not len(frame):
            return
        out = _packed(frame["fill"].to_numpy(), list(frame["pieces"]), capacity, nearly, level)
        yield out.assign(final=True) if last else out

    return run


def _unfold(batches):
    for frame in batches:
        if not len(frame):
            continue
        count = frame["pieces"].map(len).to_numpy() // _PIECE.itemsize
        x = np.frombuffer(b"".join(frame["pieces"]), _PIECE)
        length = x["length"].astype(np.int64)
        ends = np.cumsum(length)
        first = np.cumsum(count) - count
        offset = ends - length - np.repeat((ends - length)[first], count)
        yield pd.DataFrame(
            {"doc_id": C.id_or_null(x["doc_id"].copy()), "piece": x["piece"].astype(np.int32), "start": x["start"].astype(np.int64), "length": length, "ids_crc32": x["crc"].astype(np.int64), "sequence_id": np.repeat(frame["bin"].to_numpy(), count), "offset": offset}
        )


def pack_documents(docs: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 2, nearly: float = 0.99, carry: int = 20_000) -> DataFrame:
    """A row per piece of each document of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: the end id alone. Repeated rows, and rows with a null doc_id, are packed like any
    other. Other columns are ignored. An empty table gives no rows. Every piece is in exactly one sequence. A
    text of any length is encoded whole, and becomes as many pieces as it needs.

    The tree's first level has an eighth as many tasks as wrote bins. A task writes what it has after TASK_PIECES
    pieces, for its memory; bins that are open then go on like all others. `carry` only says how many tasks a
    level needs.
    """
    least = int(np.ceil(nearly * capacity))
    bins = C.materialise(T.token_rows(docs, path or T.tokenizer_path(), end_id, _local(capacity, least), _BIN), "bins")
    done = [bins.where("final")]
    level, before = 1, None
    wrote = F.countDistinct(F.shiftright("bin", 30))
    parts = bins.where("not final").agg(wrote.alias("n")).first().n
    while True:
        left = bins.where("not final").count()
        needed = -(-left // (FAN_IN * carry))
        parts = max(1, -(-parts // FAN_IN), needed)
        last = parts == 1 or level == 63 or (parts == needed and before is not None and left > 0.95 * before)
        keys = C.Buckets(parts)
        going = bins.where("not final").withColumn("b", keys.column("bin")).repartition(parts, "b").drop("b")
        bins = C.materialise(going.mapInPandas(_again(capacity, least, level, last), _BIN), "bins")
        done.append(bins.where("final"))
        if last:
            break
        level, before = level + 1, left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("bin", "pieces").mapInPandas(_unfold, _ROWS)


def lower_bound(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """sequences, and the least number that any packing needs by sum of lengths."""
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.ceil(F.sum("length") / capacity).alias("least"))
