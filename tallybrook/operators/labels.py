"""Labels of models and people: precedence, caches, and intent coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_labels(model: DataFrame, human: DataFrame) -> DataFrame:
    """review_id, label, label_source. Of models the first in file order; any human label stands above them, the last one.

    model: review_id, label, ord. human: review_id, label, skipped, ord; skipped ones and empty labels don't count.
    """
    both = model.where("label is not null and label <> ''").select("review_id", "label", F.lit("model").alias("label_source"), F.lit(1).alias("rank"), F.col("ord").alias("place"))
    people = human.where("not coalesce(skipped, false) and label is not null and label <> ''").select("review_id", "label", F.lit("human").alias("label_source"), F.lit(0).alias("rank"), (-F.col("ord")).alias("place"))
    best = both.unionByName(people).groupBy("review_id").agg(F.min_by(F.struct("label", "label_source"), F.struct("rank", "place")).alias("best"))
    return best.select("review_id", "best.*")


def attach_labels(rows: DataFrame, labels: DataFrame, key: str = "review_id") -> DataFrame:
    own = labels.withColumnRenamed("review_id", key) if key != "review_id" else labels
    return rows.drop("label", "label_source").join(own, key, "left")


def canonical(label, none: str = "unclassifiable"):
    """`__none__`, which people choose, is what models call unclassifiable."""
    return F.when(label == "__none__", none).otherwise(label)


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(requests with a cached payload, those without): a request is looked up by its whole identity."""
    own = cache.dropDuplicates([key])
    return requests.join(own, key), requests.join(own, key, "left_anti")


def secondary_totals(rows: DataFrame, primary: str = "intent", secondary: str = "intent_secondary") -> DataFrame:
    """intent, n: primary and secondary labels together."""
    return rows.select(F.explode(F.array_compact(F.array(primary, secondary))).alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


def rank_candidates(rows: DataFrame, scores: dict, top: int = 50, skip: int = 0, exclude: DataFrame | None = None, id_column: str = "review_id") -> DataFrame:
    """intent, rank, id, hits: rows that match some signal of an intent, by the number of signals, then by who came first.

    scores: intent -> Column. A row is scored for every intent in one pass; ranks over `skip` and up to `top` stay.
    """
    if exclude is not None:
        rows = rows.join(exclude.select(id_column).distinct(), id_column, "left_anti")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("intent"), c.cast("int").alias("hits")) for k, c in scores.items()]))
    scored = rows.select(id_column, "ord", pairs.alias("e")).select(id_column, "ord", "e.*").where("hits > 0")
    order = Window.partitionBy("intent").orderBy(F.desc("hits"), "ord")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > skip) & (F.col("rank") <= top)).select("intent", "rank", id_column, "hits")


def draw_size(found, per_draw: int = 50, wanted: int = 30):
    """Rows to draw next: what is missing at the yield so far, from 25 to 400."""
    rate = F.greatest(found / per_draw, F.lit(0.05))
    return F.least(F.lit(400), F.greatest(F.lit(25), F.bround((wanted - found) / rate))).cast("int")


def in_groups(rows: DataFrame, groups: dict[str, list[str]], column: str, into: str = "grp") -> DataFrame:
    """A row for each group that holds the column's value: a value may be in several, or in none."""
    found = F.array_compact(F.array(*[F.when(F.col(column).isin(members), name) for name, members in groups.items()]))
    return rows.select("*", F.explode(found).alias(into))


def job_list(variants: DataFrame, models: list[str]) -> DataFrame:
    """Every variant with every model to ask."""
    return variants.select("*", F.explode(F.array(*map(F.lit, models))).alias("model"))
