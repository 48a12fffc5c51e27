"""Redaction of personal data.

Spans are found by priority on a view of the text with ASCII digits, may not overlap one found before, and
are replaced in the text itself. Column functions have no spans, so this is an Arrow UDF; texts that no
pattern can match don't reach it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions import catalogue as K
from tallybrook.functions.text import digit_view

_PATTERNS = tuple((label, re.compile(p)) for label, p in K.PII)
_DIGITS = str.maketrans(K.OTHER_DIGITS, K.ASCII_DIGITS)
SCRUBBED = "text string, counts map<string,int>"


def scrub_text(text: str, classes: tuple[str, ...] | None = None) -> tuple[str, dict[str, int]]:
    view = text.translate(_DIGITS)
    taken: list[tuple[int, int, str]] = []  # in order, without overlaps
    counts: dict[str, int] = {}
    for label, pattern in _PATTERNS:
        if classes is not None and label not in classes:
            continue
        for m in pattern.finditer(view):
            start, end = m.span("pii")
            k = bisect_left(taken, (start,))
            if (k and taken[k - 1][1] > start) or (k < len(taken) and taken[k][0] < end):
                continue
            insort(taken, (start, end, label))
            counts[label] = counts.get(label, 0) + 1
    out, at = [], 0
    for start, end, label in taken:
        out += [text[at:start], K.PLACEHOLDERS[label]]
        at = end
    return "".join([*out, text[at:]]), counts


#: What each pattern can't do without, in the text with ASCII digits: tried first, as most texts have none of them.
_CUES = {
    "email": lambda v: F.contains(v, F.lit("@")),
    "name": lambda v: v.rlike("(?i)y name is|i am|mera na|میرا نام"),
    "": lambda v: v.rlike(r"(?sU)\d(?:.?\d){6}"),  # seven digits, with a sign between them at most
}


def may_hold_pii(text: Column, classes: tuple[str, ...] | None = None) -> Column:
    """Whether any pattern matches; the patterns are the same, in Java's form. A pattern is tried only on texts with its cue."""
    view = digit_view(text)
    found = F.lit(False)
    for cue, has in _CUES.items():
        own = [p for label, p in K.PII if (label if label in _CUES else "") == cue and (classes is None or label in classes)]
        if own:
            matches = view.rlike(K.to_java(own[0]))
            for pattern in own[1:]:
                matches = matches | view.rlike(K.to_java(pattern))
            found = found | (has(view) & matches)
    return found


def scrub(df: DataFrame, column: str = "text_clean", into: str = "text_scrubbed", counts: str = "pii_counts", classes: tuple[str, ...] | None = None) -> DataFrame:
    """df with the redacted text and the counts by class (`classes`: only of these). The UDF gets null, and does nothing, where no pattern matches."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scrub_text(x or "", classes) for x in values], columns=["text", "counts"])

    suspect = F.when(may_hold_pii(F.col(column), classes), F.col(column))
    found = df.withColumn("_found", F.pandas_udf(run, SCRUBBED)(suspect))
    touched = F.size("_found.counts") > 0
    return found.withColumn(into, F.when(touched, F.col("_found.text")).otherwise(F.col(column))).withColumn(counts, F.col("_found.counts")).drop("_found")


def records_with_pii(scrubbed: DataFrame, counts: str = "pii_counts") -> DataFrame:
    """records, and those that hold any data."""
    return scrubbed.agg(F.count("*").alias("records"), F.count_if(F.size(counts) > 0).alias("with_pii"))


def totals(scrubbed: DataFrame, counts: str = "pii_counts") -> DataFrame:
    """label, n over all rows."""
    return scrubbed.select(F.explode(counts).alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))
