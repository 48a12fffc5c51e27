"""Ids that are known, at scale: a Bloom filter of them lets most new rows pass without an exchange."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a filter, which is broadcast, at most; with more ids than it is made for, more rows take the exact way.
MOST_BYTES = 64 << 20
_CHUNK = 1 << 16


def _places(h: np.ndarray, size: int, hashes: int) -> np.ndarray:
    """hashes x ids: the bits of an id, from two halves of its hash."""
    with np.errstate(over="ignore"):
        u = h.astype(np.uint64)
        step = (u * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)) | np.uint64(1)
        return (u + np.arange(hashes, dtype=np.uint64)[:, None] * step) % np.uint64(size)


class KnownIds:
    """known (key...) and its filter: `bits` for each id, and as many hashes as suit that."""

    def __init__(self, known: DataFrame, key: tuple[str, ...] = ("platform", "review_id"), bits: int = 10):
        self.known, self.key = known.select(*key), key
        size = max(1 << 13, min(8 * MOST_BYTES, bits * self.known.count()))
        self.size = 1 << math.ceil(math.log2(size)) if size < 8 * MOST_BYTES else 8 * MOST_BYTES
        self.hashes = max(1, round(0.7 * bits))
        self._filter = known.sparkSession.sparkContext.broadcast(self._built())

    def _hash(self):
        return F.xxhash64(*self.key).alias("h")

    def _built(self) -> np.ndarray:
        size, hashes = self.size, self.hashes

        def own(batches):
            held = np.zeros(size // 8, np.uint8)
            for frame in batches:
                at = _places(frame["h"].to_numpy(), size, hashes)
                np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())
            chunks = [(k, held[k : k + _CHUNK].tobytes()) for k in range(0, len(held), _CHUNK) if held[k : k + _CHUNK].any()]
            yield pd.DataFrame(chunks, columns=["k", "bits"])

        def joined(batches):
            at, held = None, None
            for frame in batches:
                for k, raw in zip(frame["k"].tolist(), frame["bits"], strict=True):
                    if k != at and at is not None:
                        yield pd.DataFrame({"k": [at], "bits": [held.tobytes()]})
                        held = None
                    at = k
                    part = np.frombuffer(raw, np.uint8)
                    held = part.copy() if held is None else held | part
            if at is not None:
                yield pd.DataFrame({"k": [at], "bits": [held.tobytes()]})

        # A worker's filter is as large as the whole; what tasks found is joined chunk by chunk, a chunk at a time.
        parts = self.known.select(self._hash()).mapInPandas(own, "k long, bits binary").repartition("k").sortWithinPartitions("k").mapInPandas(joined, "k long, bits binary")
        out = np.zeros(self.size // 8, np.uint8)
        for r in parts.toLocalIterator():
            out[r.k : r.k + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        return out

    def maybe(self):
        """A column: false only if a row's id is not known. Null ids are ids like any other."""
        held, size, hashes = self._filter, self.size, self.hashes

        @F.pandas_udf("boolean")
        def test(h: pd.Series) -> pd.Series:
            at = _places(h.to_numpy(), size, hashes)
            return pd.Series(((held.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0))

        return test(F.xxhash64(*self.key))

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose id is not known: those that the filter lets pass go on at once, the others meet the ids in an anti-join."""
        marked = rows.withColumn("_maybe", self.maybe())
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in self.key]
        rest = marked.where("_maybe").alias("r").join(self.known.alias("k"), same, "left_anti")
        return marked.where("not _maybe").unionByName(rest).drop("_maybe")
