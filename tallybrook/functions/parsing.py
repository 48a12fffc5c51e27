"""Replies of labelling models, costs, and the choice among results of a search."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook import schemas
from tallybrook.functions.text import normal_title

_REQUIRED = [f.name for f in schemas.LABEL.fields]


def unfenced(reply: Column) -> Column:
    """The reply, or what its leading code block holds: up to the next fence, or to the end; prose after the block goes."""
    text = F.trim(reply)
    inside = F.regexp_extract(text, "(?s)^```([a-z]*)(.*?)(?:```|\\z)", 2)
    return F.when(F.startswith(text, F.lit("```")), F.trim(F.regexp_replace(inside, "^\\s+|\\s+$", ""))).otherwise(text)


def label_reply(reply: Column) -> Column:
    """The label of a structured reply, or null: a field is missing, or the confidence is not within 0 and 1."""
    bare = unfenced(reply)
    keys = F.json_object_keys(bare)
    parsed = F.from_json(bare, schemas.LABEL)
    whole = F.size(F.array_except(F.array(*map(F.lit, _REQUIRED)), keys)) == 0
    return F.when(whole & parsed["confidence"].between(0.0, 1.0) & parsed["intent"].isNotNull(), parsed)


def intent_reply(reply: Column, intents: list[str]) -> Column:
    """The intent that a reply is, or the only one that it mentions; else null."""
    cleaned = F.lower(F.trim(F.regexp_replace(F.trim(reply), "^[`\"'.]+|[`\"'.]+$", "")))
    known = F.array(*map(F.lit, intents))
    mentioned = F.filter(known, lambda i: F.contains(cleaned, i))
    return F.when(F.array_contains(known, cleaned), cleaned).when(F.size(mentioned) == 1, mentioned[0])


def quarantine(rows: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Rows with their label, and the rows whose reply is none."""
    parsed = rows.withColumn("label", label_reply(F.col(reply)))
    return parsed.where("label is not null"), parsed.where("label is null").drop("label")


def spend_usd(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column, cache_write: Column | None = None, cache_read: Column | None = None) -> Column:
    """Tokens at prices for a million; written cache at 1.25 and read cache at 0.10 of the input price."""
    total = input_tokens * input_price + output_tokens * output_price
    for tokens, share in ((cache_write, 1.25), (cache_read, 0.10)):
        if tokens is not None:
            total = total + tokens * share * input_price
    return total / 1_000_000


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def best_title_match(targets: DataFrame, results: DataFrame) -> DataFrame:
    """For each target (name, expected_app_id, expected_developer) its best result (target, app_id, title, developer, ord).

    A result with the expected id wins; else, of those by the expected developer, one without an id before
    others, then the most similar title, then the first. A target without a match has null; a match whose
    id is another than the expected one is flagged as a conflict.
    """
    pairs = results.withColumnRenamed("target", "name").join(targets, "name")
    exact = F.coalesce(F.col("app_id") == F.col("expected_app_id"), F.lit(False))
    wanted = normal_title(F.coalesce("expected_developer", F.lit("")))
    ours = (wanted == "") | (normal_title(F.coalesce("developer", F.lit(""))) == wanted)
    scored = pairs.where(exact | ours).withColumn("ratio", F.pandas_udf(_ratio, "double")(normal_title(F.col("name")), normal_title(F.coalesce("title", F.lit("")))))
    rank = F.struct(exact.cast("int"), F.col("app_id").isNull().cast("int"), F.when(exact, 0.0).otherwise(F.col("ratio")), -F.col("ord"))
    best = scored.groupBy("name").agg(F.max_by(F.struct("app_id", "title", "developer", "ratio"), rank).alias("match"))
    conflict = F.col("expected_app_id").isNotNull() & F.col("match.app_id").isNotNull() & (F.col("match.app_id") != F.col("expected_app_id"))
    return targets.join(best, "name", "left").withColumn("conflict", F.coalesce(conflict, F.lit(False)))
