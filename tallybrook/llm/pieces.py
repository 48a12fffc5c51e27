"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Marked words (a run of word marks and what follows it) are encoded apart: no piece runs from a letter into
a mark. The distinct words of a lot are sorted, which lays them out as the leaves of a trie in depth-first
order; for each word only the characters after the prefix it shares with the word before it are new, and
the forward states of that prefix are kept.

A state says how the best path to that character ends. For a unigram model it is the Viterbi score and the
last piece. For a BPE model additive scores would give other ids than the library's: there the state is the
last piece of the BPE encoding of that prefix, which is the one piece that fits its predecessor, that is,
the two of them are what BPE makes of their joined text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C
from tallybrook.llm.tokens import slices

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
KEPT_WORDS, KEPT_CHARS, LONGEST_SHARED = 700_000, 48, 2000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_READY: dict[str, PieceEncoder] = {}


def model_path(name: str = PIECE_BPE) -> str:
    return str(public_tokenizers.path(name))


def _fields(raw: bytes):
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


def is_bpe(model: bytes) -> bool:
    """The trainer's model type: 1 (the default) is unigram, 2 is BPE."""
    for number, value in _fields(model):
        if number == 2:
            return any(n == 3 and v == 2 for n, v in _fields(value))
    return False


class Forward:
    """The forward pass over sorted words; ids are those of `pieces`, or -1 - code point for a character that no piece has."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], bpe: bool):
        self.ids, self.scores, self.bpe = pieces, scores, bpe
        self.text_of = {i: p for p, i in pieces.items()}
        self.longest = max(map(len, pieces), default=1)
        # The ends of all pieces: the piece's id, or -1 where that end is none. Characters are taken back only as far as a piece goes.
        self.ends = {p[k:]: -1 for p in pieces for k in range(1, len(p))} | pieces if bpe else {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.unknown = min(scores.values(), default=0.0) - 10.0

    def merge(self, text: str) -> list[str]:
        """BPE itself: of all neighbours whose joined text is a piece, the best scored, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and score > best:
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            x, y = self.text_of[a], self.text_of[b]
            known = self.fits[key] = not self._touch(x, y) or self.merge(x + y) == [x, y]
        return known

    def _touch(self, x: str, y: str) -> bool:
        """Whether any piece could grow over the border of x and y."""
        ids = self.ids
        return any(x[i:] + y[:j] in ids for i in range(len(x)) for j in range(1, len(y) + 1) if len(x) - i + j <= self.longest)

    def _reached(self, i: int) -> bool:
        known = self.whole.get(i)
        if known is None:
            text = self.text_of[i]
            known = self.whole[i] = len(text) == 1 or self.merge(text) == [text]
        return known

    def _step(self, word: str, i: int, states: list[tuple[int, int, float]]) -> tuple[int, int, float]:
        """(start, id, score) of the last piece of the best path to i."""
        ids = self.ids
        if self.bpe:
            ends, found, j = self.ends, [], i - 1
            while j >= 0 and (t := ends.get(word[j:i])) is not None:
                if t >= 0:
                    found.append((j, t))
                j -= 1
            for j, t in reversed(found):
                if not self._reached(t):
                    continue
                if j == 0 or self._fit(states[j][1], t):
                    return j, t, 0.0
            return i - 1, -1 - ord(word[i - 1]), 0.0
        best = (i - 1, -1 - ord(word[i - 1]), states[i - 1][2] + self.unknown)
        for j in range(max(0, i - self.longest), i):
            piece = word[j:i]
            t = ids.get(piece)
            if t is not None and (score := states[j][2] + self.scores[piece]) > best[2]:
                best = (j, t, score)
        return best

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        states: list[tuple[int, int, float]] = [(0, 0, 0.0)]
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                states.append(self._step(word, i, states))
            ids, i = [], len(word)
            while i:
                start, t, _ = states[i]
                ids.append(t)
                i = start
            out[word] = ids[::-1]
            before = word
        return out


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        self.forward = Forward(pieces, {sp.id_to_piece(i): sp.get_score(i) for i in normal}, is_bpe(raw))
        self.plain = {i: p.replace(MARK, " ") for i, p in self.forward.text_of.items()}
        self.kept: dict[str, bytes] = {}

    def _final(self, ids: list[int]) -> bytes:
        """Characters without a piece become their bytes, or the unknown id."""
        if min(ids) < 0:
            spelt: list[int] = []
            for t in ids:
                if t >= 0:
                    spelt.append(t)
                elif len(self.byte) == 256:
                    spelt += [self.byte[b] for b in chr(-1 - t).encode("utf-8", "surrogatepass")]
                elif not spelt or spelt[-1] != self.unknown:
                    spelt.append(self.unknown)
            ids = spelt
        return np.array(ids, "<u4").tobytes()

    def encode(self, values: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        if len(self.forward.fits) > KEPT_WORDS:
            self.forward.fits.clear()
        cut = [_WORD.findall(self.library.normalize(x)) if x else [] for x in values]
        lacking = set().union(*cut).difference(self.kept)
        # Very long words would hold as many states; they are told apart only by themselves.
        found = self.forward.encode([w for w in lacking if len(w) <= LONGEST_SHARED])
        for w in lacking:
            if len(w) > LONGEST_SHARED:
                found |= self.forward.encode([w])
        self.kept.update((w, self._final(ids)) for w, ids in found.items())
        out = [b"".join(map(self.kept.__getitem__, words)) for words in cut]
        for w in found:
            if len(w) > KEPT_CHARS:
                del self.kept[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; marks are spaces again, and the one before the first word goes."""
        out, spelt = [], bytearray()
        try:  # most texts have pieces only
            text = "".join([self.plain[t] for t in ids.tolist()])
            return text[1:] if text[:1] == " " else text
        except KeyError:
            pass
        for t in ids.tolist():
            b = self.byte_of.get(t)
            if b is not None:
                spelt.append(b)
                continue
            if spelt:
                out.append(spelt.decode("utf-8", "replace"))
                spelt = bytearray()
            out.append(self.forward.text_of.get(t, " ⁇ " if t == self.unknown else ""))
        out.append(spelt.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def encoder(path: str) -> PieceEncoder:
    """One for each model in each Python process."""
    if path not in _READY:
        _READY[path] = PieceEncoder(path)
    return _READY[path]


def encode_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids (little-endian unsigned 32-bit) for every row of docs (doc_id, text).

    Null and empty texts have no ids. Null and repeated ids are kept; other columns are ignored.
    """
    path = path or model_path()

    def run(batches):
        for frame in batches:
            values = C.texts(frame["text"])
            for i, j in slices(values):
                raw = encoder(path).encode(values[i:j])
                yield pd.DataFrame({"doc_id": C.id_or_null(frame["doc_id"].iloc[i:j]), "n_pieces": [len(x) // 4 for x in raw], "ids": raw})

    return docs.select(C.id_column(), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_pieces long, ids binary")


def decode_rows(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give a null text."""
    path = path or model_path()

    def run(batches):
        for frame in batches:
            text = [None if x is None else encoder(path).decode(np.frombuffer(x, "<u4")) for x in frame["ids"]]
            yield pd.DataFrame({"doc_id": C.id_or_null(frame["doc_id"]), "text": text})

    return rows.select(C.id_column(), "ids").mapInPandas(run, "doc_id long, text string")


_TRIP = "doc_id long, n_pieces long, ids_crc32 long, same boolean, decoded string"


def round_trip(docs: DataFrame, path: str | None = None, then=None, schema: str = _TRIP) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, same (whether decoding gives the text back) and decoded, in one pass; nulls as in encode_rows().

    `then` goes over these batches in the same Python process.
    """
    path = path or model_path()

    def run(batches):
        for frame in batches:
            values = C.texts(frame["text"])
            for i, j in slices(values):
                tool = encoder(path)
                raw = tool.encode(values[i:j])
                text = [tool.decode(np.frombuffer(x, "<u4")) for x in raw]
                yield pd.DataFrame(
                    {
                        "doc_id": C.id_or_null(frame["doc_id"].iloc[i:j]),
                        "n_pieces": [len(x) // 4 for x in raw],
                        "ids_crc32": [zlib.crc32(x) for x in raw],
                        "same": [a == b for a, b in zip(text, values[i:j], strict=True)],
                        "decoded": text,
                    }
                )

    return docs.select(C.id_column(), F.col("text").cast("string").alias("text")).mapInPandas(run if then is None else lambda batches: then(run(batches)), schema)
