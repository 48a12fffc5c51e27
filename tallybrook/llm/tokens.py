"""Token ids of whole texts, by the tokenizers library.

A byte-level tokenizer of this kind encodes the parts of its pre-tokenizer one by one. Where single spaces
and newlines stand between other characters, a part ends before each of them, a space goes with what
follows it, and a newline is a part of its own; so is a mark after letters. Texts are cut there, and each
distinct piece is encoded by the library once and kept. Texts with runs of white space, with white space at
an end, or with other white space than spaces and newlines, are left whole. The string of a special token
gives that token, as in the library's defaults.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C
from tallybrook.llm.suffix_dedup import powers

BYTE_BPE = "byte_bpe_50k.json"
#: Bound of the ids kept (20 MB; their pieces' hashes, places and bytes take some 80 MB more).
KEPT_IDS = 5_000_000
_U32 = next(c for c in "IL" if array(c).itemsize == 4)
_READY: dict[str, PieceEncoder] = {}


def tokenizer_path(name: str = BYTE_BPE) -> str:
    return str(public_tokenizers.path(name))


class PieceEncoder:
    """Pieces are found by 64-bit hashes of their bytes, held with their places in sorted arrays (32 bytes a piece).

    The bytes of every piece are compared with those kept under its hash; one that differs is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.pool, self.spelt = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.parts = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)] * 2  # many and recent: hashes, places and numbers of ids, and of bytes

    def _raw(self, values: list[str]) -> list[bytes]:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [array(_U32, x.ids).tobytes() for x in encode(values, add_special_tokens=False)]

    def encode(self, values: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(values)
        raw = [b"\n" + x.encode("utf-8", "surrogatepass") for x in values]
        whole = [k for k, x in enumerate(raw) if _ODD.search(x) and _WHOLE.search("\n" + values[k])]
        for k, ids in zip(whole, self._raw([values[k] for k in whole]) if whole else (), strict=True):
            out[k] = ids
        kept = np.ones(len(values), bool)
        kept[whole] = False
        cut = np.flatnonzero(kept).tolist()
        if cut:
            for k, ids in zip(cut, self._pieces([raw[k] for k in cut]), strict=True):
                out[k] = ids
        return out

    def _pieces(self, raw: list[bytes]) -> list[bytes]:
        data = b"".join(raw)
        buf = np.frombuffer(data, np.uint8)
        starts = np.cumsum([0, *map(len, raw)])
        edges = _edges(buf)
        hashes = _hashes(buf, edges)
        found, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place, count, at, size = self._lookup(found)
        new = np.flatnonzero(size == 0)
        if len(new):
            spans = list(zip(edges[first[new]].tolist(), edges[first[new] + 1].tolist(), strict=True))
            own = [data[s:e] for s, e in spans]
            ids = self._raw([x.decode("utf-8", "surrogatepass") for x in own])
            count[new] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            place[new] = len(self.pool) + np.cumsum(count[new]) - count[new]
            size[new] = np.fromiter(map(len, own), np.int64, len(own))
            at[new] = len(self.spelt) + np.cumsum(size[new]) - size[new]
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), np.uint32)])
            self.spelt = np.concatenate([self.spelt, np.frombuffer(b"".join(own), np.uint8)])
            self._keep(found[new], place[new], count[new], at[new], size[new])
        each, take = count[back], place[back]
        pool = self.pool
        if len(odd := self._unlike(buf, edges, at[back], size[back])):
            ids = self._raw([data[edges[k] : edges[k + 1]].decode("utf-8", "surrogatepass") for k in odd.tolist()])
            each[odd] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            take[odd] = len(pool) + np.cumsum(each[odd]) - each[odd]
            pool = np.concatenate([pool, np.frombuffer(b"".join(ids), np.uint32)])
        upto = np.cumsum(each)
        ids = pool[np.repeat(take - (upto - each), each) + np.arange(upto[-1])]
        # The newline put before each text gives one id, which goes.
        ends = np.r_[0, upto][np.searchsorted(edges, starts)]
        told = ids.astype("<u4").tobytes()
        if len(self.pool) > KEPT_IDS:
            self._forget()
        return [told[4 * s + 4 : 4 * e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _unlike(self, buf: np.ndarray, edges: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the pieces whose bytes are not those kept under their hash."""
        own = np.diff(edges)
        unlike = own != size
        at = np.where(unlike, 0, at)  # compared with any bytes
        where = np.repeat(at - edges[:-1], own) + np.arange(len(buf))
        differ = np.flatnonzero(self.spelt[np.minimum(where, len(self.spelt) - 1)] != buf)
        if len(differ):
            unlike[np.searchsorted(edges, differ, side="right") - 1] = True
        return np.flatnonzero(unlike)

    def _lookup(self, found: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(found), np.int64) for _ in range(4)]
        for keys, *kept in self.parts:
            if len(keys):
                k = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                hit = keys[k] == found
                for x, y in zip(out, kept, strict=True):
                    x[hit] = y[k[hit]]
        return out

    def _keep(self, *new: np.ndarray) -> None:
        many, recent = self.parts
        recent = _merged(recent, new)
        if len(recent[0]) > 50_000 + len(many[0]) // 4:
            many, recent = _merged(many, recent), tuple(x[:0] for x in recent)
        self.parts = [many, recent]


def _merged(a, b):
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


#: After the newline put first: two separators in a row, one at the end, or other white space.
_WHOLE = re.compile(r"[ \n][ \n]|[ \n]\Z|[^\S \n]")
#: The same in bytes, where some of the bytes may be of other white space.
_ODD = re.compile(rb"[ \n][ \n]|[ \n]\Z|[\x00-\x09\x0b-\x1f\x7f\xc2\xe1-\xe3]")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def _edges(buf: np.ndarray) -> np.ndarray:
    """Starts of the pieces, and the end: at separators, and at a mark that ends a word of Latin letters."""
    gap = (buf == 32) | (buf == 10)
    at = np.flatnonzero(gap)
    ends = np.r_[at[1:], len(buf)]
    letter = _LETTER[buf]
    pair = np.zeros(len(buf), bool)  # two bytes of a letter of the Latin-1 range
    pair[:-1] = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    letter |= pair
    letter[1:] |= pair[:-1]
    others = np.r_[0, np.cumsum(~letter, dtype=np.int32)]
    last = ends - 1
    split = (last > at + 1) & _MARK[buf[last]] & (others[last] == others[np.minimum(at + 1, len(buf))])
    return np.sort(np.concatenate([at, last[split], [len(buf)]]))


def _hashes(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece's bytes, by prefix sums. Equal hashes of unlike pieces can be made, so bytes are compared too."""
    up, down = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(buf)], out=sums[1:])
        out = (sums[edges[1:]] - sums[edges[:-1]]) * down[edges[:-1]]
        out = (out ^ (out >> np.uint64(29)) ^ (np.diff(edges).astype(np.uint64) << np.uint64(50))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def encoder(path: str) -> PieceEncoder:
    """One for each file in each Python process; what it has kept serves later tasks too."""
    if path not in _READY:
        _READY[path] = PieceEncoder(path)
    return _READY[path]


def slices(values: list[str], chars: int = 1_000_000):
    """Ranges of texts of about so many characters."""
    first, held = 0, 0
    for k, text in enumerate(values):
        held += len(text)
        if held >= chars:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(values):
        yield first, len(values)


TOKENS = "doc_id long, n long, ids binary"


def tokenised(path: str, end_id: int):
    """For batches of (doc_id, text): doc_id, n (its ids, the end id included) and ids, zstandard over planes()."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        tool, end = encoder(path), np.uint32(end_id).tobytes()
        for frame in batches:
            values = C.texts(frame["text"])
            for i, j in slices(values):
                raw = [x + end for x in tool.encode(values[i:j])]
                yield pd.DataFrame({"doc_id": C.id_or_null(frame["doc_id"].iloc[i:j]), "n": [len(x) // 4 for x in raw], "ids": [pack.compress(planes(x)) for x in raw]})
        C.release()

    return run


def token_rows(docs: DataFrame, path: str, end_id: int = 2, then=None, schema: str = TOKENS) -> DataFrame:
    """A row per row of docs (doc_id, text) as tokenised() makes it; `then` goes over these batches in the same Python process."""
    first = tokenised(path, end_id)
    run = first if then is None else lambda batches: then(first(batches))
    return docs.select(C.id_column(), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def planes(raw: bytes) -> bytes:
    """The bytes of each rank together: high bytes are mostly zero and pack well."""
    return np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
