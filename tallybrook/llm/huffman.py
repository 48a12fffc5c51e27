"""Token ids as canonical, length-limited Huffman code.

One code for the corpus, from global counts (package-merge). A file holds documents in id order: the code
lengths, the documents' ids and lengths, and blocks of 16,384 ids that start on a byte each. Within a block
the bit offset of every 256th id is kept, so a table-driven decoder runs over all these places at once.

    magic "TBH1" | u32 header bytes | header (zstandard): u64 ids before it in its part, u32 documents,
    u32 ids, u32 symbols, lengths u8[symbols], doc_id i64[documents], n u32[documents],
    checkpoints u64[ceil(ids / 256)] in bits from the payload's start | payload
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C
from tallybrook.llm import tokens as T

LIMIT, EVERY, BLOCK, FILE_IDS = 20, 256, 16_384, 1 << 20
_MAGIC = b"TBH1"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (0: does not occur)."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit into {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    rows, leaf, level = weight, np.ones(len(weight), bool), []
    level.append(leaf)
    for _ in range(limit - 1):
        pairs = rows[: len(rows) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        rows, leaf = both[order], order < len(weight)
        level.append(leaf)
    take, lengths = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for leaf in reversed(level):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        code <<= 1
        codes[own] = code + np.arange(len(own), dtype=np.uint32)
        code += len(own)
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and checkpoints."""
    n = lengths[ids].astype(np.int64)
    at = np.cumsum(n) - n
    starts = np.arange(0, len(ids), BLOCK)
    if len(starts):
        pad = np.zeros(len(starts), np.int64)
        ends = np.r_[at[starts[1:]], n.sum()]
        shift = 0
        for k, (s, e) in enumerate(zip(at[starts].tolist(), ends.tolist(), strict=True)):
            pad[k] = shift
            shift += -(e - s) % 8
        at += np.repeat(pad, np.diff(np.r_[starts, len(ids)]))
    total = int(at[-1] + n[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    code, size = codes[ids].astype(np.uint64), n.astype(np.uint64)
    room = np.uint64(64) - bit
    fits = size <= room
    left = np.where(fits, code << np.where(fits, room - size, np.uint64(0)), code >> np.where(fits, np.uint64(0), size - room))
    s, _ = C.runs(word)
    if len(s):
        words[word[s]] = np.bitwise_or.reduceat(left, s)
        over = np.flatnonzero(~fits)
        words[word[over] + 1] |= code[over] << (np.uint64(64) - (size[over] - room[over]))
    return words.astype(">u8").tobytes()[: -(-total // 8)], at[::EVERY].astype(np.uint64)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for each value of the next `width` bits."""
    width = max(1, int(lengths.max(initial=1)))
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = np.int64(1) << (width - lengths[used].astype(np.int64))
    symbols, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    assert (codes[used].astype(np.int64) << (width - lengths[used].astype(np.int64)) == np.cumsum(span) - span).all()
    symbols[: span.sum()] = np.repeat(used, span)
    sizes[: span.sum()] = np.repeat(lengths[used], span)
    return symbols, sizes, width


def unpack_bits(payload: bytes, checkpoints: np.ndarray, count: int, table) -> np.ndarray:
    symbols, sizes, width = table
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    peek = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((len(checkpoints), EVERY), np.uint32)
    at = checkpoints.astype(np.int64)
    last = len(peek) - 1
    for k in range(min(EVERY, count)):
        value = ((peek[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) & np.uint32(0xFFFFFFFF)) >> np.uint32(32 - width)
        out[:, k] = symbols[value]
        at += sizes[value]
    return out.ravel()[:count]


def write_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, start: int = 0) -> bytes:
    payload, checkpoints = pack_bits(ids, lengths, canonical(lengths))
    header = struct.pack("<QIII", start, len(doc_ids), len(ids), len(lengths)) + lengths.tobytes() + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + checkpoints.astype("<u8").tobytes()
    header = zstandard.ZstdCompressor(level=3).compress(header)
    return _MAGIC + struct.pack("<I", len(header)) + header + payload


def read_file(raw: bytes, tables: dict | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Ids before it in its part, document ids, their numbers of ids, and the ids."""
    if raw[:4] != _MAGIC:
        raise ValueError("not a file of this format")
    size = struct.unpack("<I", raw[4:8])[0]
    header = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
    start, docs, count, symbols = struct.unpack("<QIII", header[:20])
    at = 20
    fields = []
    for kind, n in (("u1", symbols), ("<i8", docs), ("<u4", docs), ("<u8", -(-count // EVERY))):
        fields.append(np.frombuffer(header, kind, n, at))
        at += n * np.dtype(kind).itemsize
    lengths, doc_ids, counts, checkpoints = fields
    tables = {} if tables is None else tables
    key = zlib.crc32(lengths.tobytes())
    if key not in tables:
        tables.clear()
        tables[key] = decoding_table(lengths)
    return start, doc_ids, counts, unpack_bits(raw[8 + size :], checkpoints, count, tables[key])


def global_counts(tokens: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs. The driver gets a row per symbol at most."""

    def run(batches):
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(symbols, np.int64)
        for frame in batches:
            for raw in frame["ids"]:
                total += np.bincount(T.unplanes(unpack.decompress(raw)), minlength=symbols) if len(raw) > 40_000 else 0
            small = [T.unplanes(unpack.decompress(raw)) for raw in frame["ids"] if len(raw) <= 40_000]
            if small:
                total += np.bincount(np.concatenate(small), minlength=symbols)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"symbol": used.astype(np.int32), "times": total[used]})

    out = np.zeros(symbols, np.int64)
    for row in tokens.select("ids").mapInPandas(run, "symbol int, times long").groupBy("symbol").agg(F.sum("times").alias("times")).collect():
        out[row.symbol] = row.times
    return out


def write_files(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    """part, number, n_tokens, content: files in the order of (part, number); parts are ranges of doc_id, rows of one id in the order of
    their ids' hash. A file ends after FILE_IDS ids, so a task holds one file's."""

    def run(batches):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        unpack = zstandard.ZstdDecompressor()
        d, rows, held = [], [], 0

        def flush() -> pd.DataFrame:
            content = write_file(np.array(d, np.int64), np.array([len(x) for x in rows], np.int64), np.concatenate(rows), lengths, before)
            return pd.DataFrame([{"part": part, "number": number, "n_tokens": held, "content": content}])

        for frame in batches:
            for i, raw in zip(C.ids(frame["doc_id"]).tolist(), frame["ids"], strict=True):
                d.append(i)
                rows.append(T.unplanes(unpack.decompress(raw)))
                held += len(rows[-1])
                if held >= FILE_IDS:
                    yield flush()
                    number, before = number + 1, before + held
                    d, rows, held = [], [], 0
        if d:
            yield flush()

    n = C.partitions(tokens.sparkSession)
    ordered = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    return ordered.select("doc_id", "ids").mapInPandas(run, "part int, number int, n_tokens long, content binary")


def encode_corpus(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Tokenises docs (doc_id, text), writes the files into the shared folder and returns them as a table.

    Null text is empty: the end id alone. A null doc_id comes first; rows that repeat a doc_id are ordered
    by a hash of their ids, so neither fills one task. A text of any length is encoded whole, and stands in one
    file. Other columns are ignored. An empty table gives no files.
    """
    path = path or T.tokenizer_path()
    tokens = C.materialise(T.token_rows(docs, path, end_id), "tokens")
    symbols = max(T.encoder(path).library.get_vocab_size(), end_id + 1)
    lengths = code_lengths(global_counts(tokens, symbols))
    files = C.materialise(write_files(tokens, lengths), "huffman")
    C.discard(tokens)
    return files


def decode_corpus(files: DataFrame, then=None, schema: str = "doc_id long, start long, n_tokens long, ids binary") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, read from the files; `then` goes over these batches in the same Python process."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, base = 0, {}
    for row in totals:
        base[row.part] = before
        before += row.n

    def run(batches):
        tables: dict = {}
        for frame in batches:
            for part, content in zip(frame["part"], frame["content"], strict=True):
                start, doc_ids, counts, ids = read_file(content, tables)
                ends = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": C.id_or_null(doc_ids), "start": base[part] + start + ends - counts, "n_tokens": counts.astype(np.int64), "ids": parts})

    return files.select("part", "content").mapInPandas(run if then is None else lambda batches: then(run(batches)), schema)
