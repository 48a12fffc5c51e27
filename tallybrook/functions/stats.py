"""Intervals, agreement and power as Column expressions, and the permutation test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.959964
Z_SCRIPTS = 1.96
Z_BETA = 0.841621


def pct(hits: Column, total: Column, digits: int = 1) -> Column:
    """hits of total in percent, rounded half to even; null without a total."""
    return F.bround(F.try_divide(F.lit(100.0) * hits, total), digits)


def wilson(hits: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval of a share, within 0 and 1; (0, 0) for no rows."""
    n, p = total.cast("double"), F.try_divide(hits.cast("double"), total.cast("double"))
    below = F.lit(1.0) + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / below
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / below
    none = (total == 0) | total.isNull()
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + half))


def minimum_detectable_effect(baseline: Column, n: Column) -> Column:
    """Smallest difference of two groups found with 80% power at 5%; 1 if a group is empty."""
    return F.when(n <= 0, 1.0).otherwise((Z + Z_BETA) * F.sqrt(F.try_divide(2 * baseline * (1 - baseline), n)))


def required_n(baseline: Column, effect: Column) -> Column:
    return F.when(effect <= 0, 0).otherwise(F.ceil(2 * baseline * (1 - baseline) * F.pow(F.try_divide(F.lit(Z + Z_BETA), effect), F.lit(2.0)))).cast("long")


def kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of two label columns for each group of `by`: n, agree, kappa (null where it is undefined)."""
    by = by or []
    cells = pairs.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    cells = cells.withColumn("_all", F.lit(1))
    keys = [*by, "_all"]
    rows = cells.groupBy(*keys, F.col(a).alias("_label")).agg(F.sum("n").alias("n_a"))
    cols = cells.groupBy(*keys, F.col(b).alias("_label")).agg(F.sum("n").alias("n_b"))
    chance = rows.join(cols, [*keys, "_label"]).groupBy(*keys).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("chance"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agree"))
    expected = F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    observed = F.col("agree") / F.col("n")
    out = total.join(chance, keys, "left").withColumn("kappa", F.when(F.coalesce("chance", F.lit(0)) != F.col("n") * F.col("n"), (observed - expected) / (1 - expected)))
    return out.select(*by, "n", "agree", "kappa")


def group_rates(outcomes: DataFrame, group: str, correct: str) -> DataFrame:
    return outcomes.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("hits"))


def spread(rates: DataFrame) -> DataFrame:
    """Largest less smallest rate of groups (n, hits); 0 for fewer than two groups."""
    share = F.col("hits") / F.col("n")
    return rates.agg(F.when(F.count("*") < 2, 0.0).otherwise(F.max(share) - F.min(share)).alias("spread"), F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("n").alias("smallest"))


def permutation_test(outcomes: DataFrame, group: str, correct: str, rounds: int = 20_000, seed: int = 0) -> DataFrame:
    """observed spread, and the share of label shuffles that match or exceed it.

    A shuffle with fixed group sizes and a fixed number of hits is one draw of the multivariate
    hypergeometric distribution, so a round costs the number of groups, not of rows. The driver gets a row
    for each group.
    """
    spark = outcomes.sparkSession
    rows = group_rates(outcomes, group, correct).orderBy(group).collect()
    sizes, hits = np.array([r.n for r in rows], np.int64), sum(r.hits for r in rows)
    observed = float(np.ptp([r.hits / r.n for r in rows])) if len(rows) > 1 else 0.0

    def run(batches):
        for frame in batches:
            found = []
            for k in frame["id"]:  # each lot of rounds has a stream of its own
                draws = np.random.default_rng([seed, int(k)]).multivariate_hypergeometric(sizes, hits, size=min(1000, rounds - 1000 * int(k))) / sizes
                found.append(int((np.ptp(draws, axis=1) >= observed - 1e-12).sum()))
            yield pd.DataFrame({"at_least": found})

    if len(rows) < 2:
        return spark.createDataFrame([(observed, 1.0, rounds)], "observed double, p double, rounds long")
    lots = spark.range(0, -(-rounds // 1000))
    found = lots.mapInPandas(run, "at_least long")
    return found.agg(F.lit(observed).alias("observed"), (F.sum("at_least") / rounds).alias("p"), F.lit(rounds).cast("long").alias("rounds"))


def permutation_tests(cells: DataFrame, by: str, group: str, rounds: int = 4000, seed: int = 0) -> DataFrame:
    """by, p: permutation_test() for each value of `by` (a model, say), in one job over the counts (by, group, n, hits).

    Groups are few, so a task holds one value's counts.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(group)
        sizes, hits = frame["n"].to_numpy(np.int64), frame["hits"].to_numpy(np.int64)
        p = 1.0
        if len(frame) > 1:
            observed, found = float(np.ptp(hits / sizes)), 0
            for at in range(0, rounds, 1000):
                draws = np.random.default_rng([seed, at // 1000]).multivariate_hypergeometric(sizes, int(hits.sum()), size=min(1000, rounds - at)) / sizes
                found += int((np.ptp(draws, axis=1) >= observed - 1e-12).sum())
            p = found / rounds
        return pd.DataFrame({by: [frame[by].iloc[0]], "p": [p]})

    return cells.select(by, group, "n", "hits").groupBy(by).applyInPandas(run, f"{by} string, p double")
