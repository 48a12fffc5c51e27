"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every 64-bit shingle hash below a fixed fraction of the hash range, so sketches of texts of
any size merge by union and compare where both are complete. Short texts would keep next to nothing: a
sketch also keeps its `least` smallest hashes, which still merges (the smallest of a union are among the
smallest of its parts), and says up to where it is complete.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C

WORDS, FRACTION, LEAST = 5, 3, 12
_TOP = (1 << 64) - 1


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of `words` lower-cased words (fewer words: the whole sequence; none: nothing)."""
    found = [w.encode("utf-8", "surrogatepass") for w in text.lower().split()]
    if not found:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(words, len(found))
    data, digest = b" ".join(found), xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(data[s:e]) for s, e in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def sketch(hashes: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> np.ndarray:
    """What is kept of sorted distinct hashes: all below 1/fraction of the range, and the `least` smallest."""
    return hashes[: max(least, int(np.searchsorted(hashes, np.uint64(_TOP // fraction))))]


def complete_to(kept: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> int:
    """Every hash of the text up to here is in its sketch."""
    if len(kept) < least:
        return _TOP
    return max(_TOP // fraction - 1, int(kept[-1]))


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return sketch(np.union1d(a, b), fraction, least)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the Jaccard similarity of the shingle sets; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    top = np.uint64(min(complete_to(a), complete_to(b)))
    a, b = a[a <= top], b[b <= top]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the share of a's shingles that b has, however unequal their sizes; 1 if a is empty."""
    if not len(a):
        return 1.0
    top = np.uint64(min(complete_to(a), complete_to(b)))
    a, b = a[a <= top], b[b <= top]
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, len(a))


def to_text(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype("<u8").tobytes()).decode()


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(value), "<u8")


def fingerprint(text: str) -> np.ndarray:
    return sketch(shingle_hashes(text))


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs (doc_id, text); null text is empty."""

    def run(batches):
        for frame in batches:
            yield pd.DataFrame({"doc_id": C.id_or_null(frame["doc_id"]), "fingerprint": [to_text(fingerprint(x)) for x in C.texts(frame["text"])]})

    return docs.select(C.id_column(), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many of the first characters of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Ranges:
    """Ranges of rows in the order of (id, hash of the text), of about equal counts. An id that has several shares of all rows
    (null, say) has as many ranges, by the hash."""

    def __init__(self, cuts: list[int]):
        at, shares = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.at, self.shares = at, np.where(shares > 1, shares, 0)  # ranges that an id has to itself
        self.first = np.cumsum(np.r_[0, 1 + self.shares])

    def of(self, k: np.ndarray, h: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at, k, side="left")
        own = self.first[i]
        if len(self.at):
            near = np.minimum(i, len(self.at) - 1)
            shares = np.where(self.at[near] == k, self.shares[near], 0)
            high = (h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)  # in the order of h
            own = own + np.where(shares > 0, 1 + ((high.astype(np.int64) * shares) >> 32), 0)
        return own.astype(np.int32)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints every row of docs (doc_id, text), its edited text, and compares both with it and with the next row's.

    The next row is the one that follows by doc_id, after the last the first; rows of one id by the hash of their
    texts, and by the texts. Null text is empty; a null doc_id comes first; repeated rows follow one another. Other
    columns are ignored. Texts of any length are read whole. An empty table gives no rows.

    Rows go to ranges once, and are read there in order; with a range goes the first row of the range after it (and
    to the last, the first of all), found by minima, so no row needs all the others in one task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(C.id_column().alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    n = C.partitions(spark)
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("c")).first().c if n > 1 else []
    ranges = Ranges(cuts or [])

    @F.pandas_udf("int")
    def place(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(k.to_numpy(), h.to_numpy()))

    heads = sorted((x.r, x.m.k, x.m.h) for x in rows.groupBy(place("k", "h").alias("r")).agg(F.min(F.struct("k", "h")).alias("m")).collect())
    if not heads:
        return spark.createDataFrame([], _OUT)
    keys = C.Buckets(len(heads)).keys
    at, first_k, first_h = (np.array(x, np.int64) for x in zip(*heads, strict=True))

    @F.pandas_udf("home int, before int")
    def deal(k: pd.Series, h: pd.Series) -> pd.DataFrame:
        k, h = k.to_numpy(), h.to_numpy()
        i = np.searchsorted(at, ranges.of(k, h))
        head = (first_k[i] == k) & (first_h[i] == h)
        return pd.DataFrame({"home": keys[i].astype(np.int32), "before": pd.Series(keys[i - 1]).astype("Int32").mask(~head)})

    def to(b, guest: bool):
        return F.struct(b.alias("b"), F.lit(guest).alias("guest"))

    sent = F.explode(F.when(F.col("d.before").isNull(), F.array(to(F.col("d.home"), False))).otherwise(F.array(to(F.col("d.home"), False), to(F.col("d.before"), True))))
    dealt = rows.withColumn("d", deal("k", "h")).select(sent.alias("s"), "k", "h", "text").select("s.b", "s.guest", "k", "h", "text")
    dealt = dealt.repartition(len(heads), "b").sortWithinPartitions("b", "guest", "k", "h", "text")

    def run(batches):
        before = None  # range, id, text and fingerprint of the row that waits for its next
        for frame in batches:
            out = []
            for b, guest, k, text in zip(frame["b"].tolist(), frame["guest"].tolist(), frame["k"].tolist(), frame["text"], strict=True):
                waits = before is not None and before[0] == b
                if guest and not waits:
                    continue
                now = fingerprint(text)
                if waits:
                    changed = edited(before[2], text)
                    other = fingerprint(changed)
                    own = before[3]
                    out.append((before[1], len(before[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(other), likeness(own, other), likeness(own, now)))
                before = None if guest else (b, k, text, now)
            if out:
                part = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                yield part.assign(doc_id=C.id_or_null(part["doc_id"]))

    return dealt.select("b", "guest", "k", "text").mapInPandas(run, _OUT)
