"""A labelling run: cached answers first, each text asked once, what is new kept by its key."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallybrook import schemas
from tallybrook.functions import text as X

_LABEL = [f.name for f in schemas.LABEL.fields]
_KIND = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schemas.LABEL.fields)
ANSWER = f"key string, label struct<{_KIND}>, input_tokens long, output_tokens long"


class Predictor(Protocol):
    """Answers requests: (key, text) in, ANSWER out, a row a key. A null label is no answer: it isn't kept, and is asked for again."""

    def answers(self, misses: DataFrame) -> DataFrame: ...


class TablePredictor:
    """Answers from a table of ANSWER: labels that were made elsewhere. Keys that it lacks get none."""

    def __init__(self, table: DataFrame):
        self.table = table

    def answers(self, misses: DataFrame) -> DataFrame:
        return misses.select("key").join(self.table.dropDuplicates(["key"]), "key").select("key", "label", "input_tokens", "output_tokens")


class RowPredictor:
    """Asks a model in the tasks: `make` builds it once a task, and it takes a text to (label: dict or None, input tokens, output tokens).

    A call that fails is tried `attempts` times in all; then the task fails, and answers of tasks that ended stay.
    """

    def __init__(self, make: Callable[[], Callable[[str], tuple[dict | None, int, int]]], attempts: int = 1):
        self.make, self.attempts = make, attempts

    def answers(self, misses: DataFrame) -> DataFrame:
        make, attempts = self.make, self.attempts

        def ask(model, text: str):
            for left in range(attempts, 0, -1):
                try:
                    return model(text)
                except Exception:
                    if left == 1:
                        raise

        def run(batches):
            model = make()
            for frame in batches:
                found = [ask(model, x) for x in frame["text"]]
                labels = [None if label is None else {c: label.get(c) for c in _LABEL} for label, _, _ in found]
                yield pd.DataFrame({"key": frame["key"], "label": labels, "input_tokens": [n for _, n, _ in found], "output_tokens": [n for _, _, n in found]})

        return misses.mapInPandas(run, ANSWER)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Kept answers, one a key: runs that asked at the same time may have kept two, of which the first run's by name counts."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ANSWER)
    rows = spark.read.schema(f"{ANSWER}, run string").parquet(path)
    return rows.groupBy("key").agg(F.min_by(F.struct("label", "input_tokens", "output_tokens"), "run").alias("r")).select("key", "r.*")


def label_run(records: DataFrame, predictor: Predictor, cache: str, model: str, prompt_version: str, taxonomy_version: int, text: str = "text_scrubbed", run: str | None = None) -> tuple[DataFrame, dict]:
    """(records with label_* columns, what the run spent: live_calls, cache_hits, unanswered, input_tokens, output_tokens).

    A request's key is the text with model, prompt and taxonomy. Keys that the cache lacks are asked once each, however many
    records have them; copies meet by their key, combined before the exchange. Answers go to cache/run=..., a run of the same name writes
    its folder anew, so a run that died and starts again asks only what no run has kept. Records without an answer keep
    null labels.
    """
    spark = records.sparkSession
    run = run or uuid.uuid4().hex
    keyed = records.withColumn("_key", X.cache_key(model, prompt_version, taxonomy_version, F.coalesce(F.col(text), F.lit(""))))
    known = read_cache(spark, cache)
    asked = keyed.groupBy(F.col("_key").alias("key")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text")).join(known.select("key"), "key", "left_anti")
    seen, records_seen = Observation(), Observation()
    found = predictor.answers(asked).observe(
        seen, F.count("*").alias("live_calls"), F.count_if(F.col("label").isNull()).alias("unanswered"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens")
    )
    found.where("label is not null").write.mode("overwrite").parquet(f"{cache}/run={run}")
    keyed.observe(records_seen, F.count("*").alias("n")).select(F.lit(1)).write.format("noop").mode("overwrite").save()
    spend = dict(seen.get)
    spend["cache_hits"] = records_seen.get["n"] - spend["live_calls"]
    labels = read_cache(spark, cache).select(F.col("key").alias("_key"), "label")
    names = [F.col(f"label.{c}").alias(f"label_{c}") for c in _LABEL]
    return keyed.join(labels, "_key", "left").select(*records.columns, *names), spend
