"""What is still to be judged, and how far a pass has come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.operators.clean import last_wins

MODES = ("all", "controls", "recheck", "revisit")


def answers(predictions: Column) -> Column:
    return F.filter(F.map_values(predictions), lambda x: x.isNotNull() & (x != ""))


def models_agree(predictions: Column) -> Column:
    return F.size(F.array_distinct(answers(predictions))) == 1


def is_control(predictions: Column) -> Column:
    """More than one model answered, all alike."""
    return (F.size(answers(predictions)) > 1) & models_agree(predictions)


def usable(skipped: Column, label: Column) -> Column:
    return ~F.coalesce(skipped, F.lit(False)) & (F.coalesce(label, F.lit("")) != "")


def public_view(items: DataFrame, reveal: bool = False) -> DataFrame:
    """Items as a judge sees them: predictions are not there unless revealed."""
    return items.select("id", "text", "meta", *(["predictions"] if reveal else []))


def shuffled(rows: DataFrame, key: str, seed: int = 0, limit: int | None = None) -> DataFrame:
    """A reproducible order by hash; no limit, or 0, means all."""
    out = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    return out.limit(limit) if limit else out


def worklist(items: DataFrame, judgements: DataFrame, mode: str = "all", limit: int | None = None, seed: int = 0, label_version: int = 0, needs_revisit: Column | None = None, pass_id: str | None = None) -> DataFrame:
    """Items of a pass, in random order. Judgements: item_id, label_version, maybe pass_id.

    A recheck judges items again: with a pass_id, only what that pass has judged leaves its list.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    judged = judgements.select(F.col("item_id").alias("id")).distinct()
    if mode == "recheck":
        out = items.join(judged, "id", "left_semi")
        if pass_id is not None:
            out = out.join(judgements.where(F.col("pass_id") == pass_id).select(F.col("item_id").alias("id")), "id", "left_anti")
    elif mode == "revisit":
        old = judgements.where(F.col("label_version") < label_version).select(F.col("item_id").alias("id"), F.struct(*judgements.columns).alias("judgement"))
        out = items.join(old, "id")
        out = (out if needs_revisit is None else out.where(needs_revisit)).drop("judgement")
    else:
        out = (items.where(is_control(F.col("predictions"))) if mode == "controls" else items).join(judged, "id", "left_anti")
    return shuffled(out, "id", seed, limit)


def counts(items: DataFrame, judgements: DataFrame, label_version: int = 0) -> DataFrame:
    """Items left in each mode, in one pass over the items."""
    own = judgements.select(F.col("item_id").alias("id"), "label_version", F.lit(True).alias("judged"))
    control, judged = is_control(F.col("predictions")), F.col("judged").isNotNull()
    return items.join(own, "id", "left").agg(F.count_if(~judged).alias("all"), F.count_if(control & ~judged).alias("controls"), F.count_if(judged).alias("recheck"), F.count_if(judged & (F.col("label_version") < label_version)).alias("revisit"))


def progress(todo: DataFrame, judgements: DataFrame, mode: str, label_version: int = 0) -> DataFrame:
    """done, total of this list; a revisit counts only judgements of the present version."""
    own = judgements if mode != "revisit" else judgements.where(F.col("label_version") >= label_version)
    own = own.select(F.col("item_id").alias("id"), F.lit(1).alias("_done")).distinct()
    return todo.join(own, "id", "left").agg(F.count("_done").alias("done"), F.count("*").alias("total"))


def upsert(judgements: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """The last record of each key, old records before new ones; both have ord."""
    top = judgements.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top"))
    after = new.join(F.broadcast(top)).withColumn("ord", F.col("ord") + F.col("top") + 1).drop("top")  # top is one row
    both = judgements.unionByName(after)
    key = F.to_json(F.struct(*keys))
    return last_wins(both.withColumn("_key", key), "_key").drop("_key", "first_ord")


def nth_latest(judgements: DataFrame, steps: int = 1) -> DataFrame:
    """The judgement made `steps` ago."""
    return judgements.orderBy(F.desc("ord")).offset(steps - 1).limit(1)
