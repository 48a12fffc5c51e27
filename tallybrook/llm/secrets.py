"""Secrets in texts: three fixed patterns, and high-entropy strings.

Entropy: a candidate is a run of one character class (hex digits, or base64 digits). A window slides over
it, and the Shannon entropy of its characters is kept by incremental counts: one character leaves, one
enters, and only their two terms of the sum change. Windows over the class's threshold mark a span; spans
that allow-listed strings explain (words, repeated or counting characters, UUIDs, URLs) are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C

# Fixed values of the base patterns; only letters of the ASCII range fold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex")

# With the least length inside the pattern the same runs match: a run that is too short holds no longer one.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")

#: (kind, candidate, window, bits a character): random hex digits reach about 3.4 bits in 24, base64 about 4.3.
CLASSES = (
    ("entropy_hex", re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])"), 24, 3.0),
    ("entropy_base64", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"), 24, 4.0),
)
ALLOWED = (
    re.compile(r"\A[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z"),  # UUID
    re.compile(r"\A[a-z]+(?:[-_/][a-z]+)*\Z", re.I),  # words only
    re.compile(r"\A\d+\Z"),  # a number
    re.compile(r"(?i)\A(?:0123456789abcdef|abcdefghijklmnop|example|changeme|dummy|placeholder)"),
)
_TERM = [0.0] + [n * math.log2(n) for n in range(1, 257)]


def entropy_spans(value: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal ranges of value that windows of at least `bits` bits a character cover."""
    size = min(window, len(value))
    counts: dict[str, int] = {}
    total = 0.0  # sum of n log2 n; entropy = log2(size) - total / size
    most = size * (math.log2(size) - bits) if size else 0.0
    spans: list[list[int]] = []
    for k, c in enumerate(value):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if k >= size:
            gone = value[k - size]
            n = counts[gone]
            total += _TERM[n - 1] - _TERM[n]
            counts[gone] = n - 1
        if k >= size - 1 and total <= most + 1e-9:
            s = k - size + 1
            if spans and s <= spans[-1][1]:
                spans[-1][1] = k + 1
            else:
                spans.append([s, k + 1])
    return [(s, e) for s, e in spans]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), ordered; leftmost and non-overlapping within a kind, too short ones dropped."""
    found = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _LONG_ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of high-entropy strings outside the allow-list; those that lie within base spans, or within others, are told by them."""
    found: list[tuple[int, str, int]] = []
    for kind, pattern, window, bits in CLASSES:
        taken = _merged([(s, e) for s, _, e in base] + [(s, e) for s, _, e in found])
        starts = [s for s, _ in taken]
        for m in pattern.finditer(text):
            if any(a.search(m.group()) for a in ALLOWED):
                continue
            for s, e in entropy_spans(m.group(), window, bits):
                s, e = s + m.start(), e + m.start()
                before = bisect_right(starts, s) - 1  # the last taken range that starts at s or before
                if before < 0 or taken[before][1] < e:
                    found.append((s, kind, e))
    return sorted(found)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(text: str) -> tuple[int, int, int, str, str]:
    """Counts of the three kinds, the digest of the base spans, and all spans."""
    base = base_spans(text)
    named = [(s, KINDS[k], e) for s, k, e in base]
    counts = [sum(k == n for _, k, _ in base) for n in range(3)]
    own = ",".join(f"{k}:{s}:{e}" for s, k, e in named)
    order = {k: n for n, k in enumerate((*KINDS, *(c[0] for c in CLASSES)))}
    every = sorted(named + added_spans(text, base), key=lambda x: (x[0], order[x[1]], x[2]))
    return (*counts, hashlib.sha256(own.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in every))


def redact(text: str, spans: str, mark: str = "<secret>") -> str:
    """The text with its spans (as scan() gives them) replaced; overlapping ones become one."""
    out, at = [], 0
    for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if x)):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


_SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text is empty. Null and repeated ids are kept as they are; other columns are ignored. A text of any length is
    scanned whole; an empty table gives no rows. Offsets are code points, ends exclusive.
    """

    def run(batches):
        for frame in batches:
            rows = [scan(x) for x in C.texts(frame["text"])]
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", C.id_or_null(frame["doc_id"]))
            yield out

    return docs.select(C.id_column(), F.col("text").cast("string").alias("text")).mapInPandas(run, _SCANNED)


def redact_secrets(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with every found secret replaced in its text; all columns and rows stay, a null text stays null."""

    @F.pandas_udf("string")
    def clean(values: pd.Series) -> pd.Series:
        return pd.Series([redact(x, scan(x)[4], mark) if isinstance(x, str) else None for x in values])

    return docs.withColumn("text", clean(F.col("text")))
