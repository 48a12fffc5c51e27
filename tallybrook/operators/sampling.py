"""Reproducible samples. The order within a stratum is by a hash of seed and key, so a draw doesn't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions import catalogue as K
from tallybrook.functions import text as X
from tallybrook.operators.worklists import shuffled
from tallybrook.sources.shared import materialise


def draw_key(seed: int, key: str | Column) -> Column:
    column = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), column.cast("string")), 256)


def nth_in(by: list, order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


#: Draws are hex digits; the first 15 are a number below this.
_ALL = 16**15


def drawn(rows: DataFrame, by: list[str], want: int | DataFrame, seed: int, key: str = "review_id", sizes: DataFrame | None = None) -> DataFrame:
    """The `want` rows of each stratum that come first by the hash of seed and key, with their place in `_k`.

    want: a number, or a table (by, want); strata that it lacks give none. A stratum's size tells below which hash its first `want`
    rows lie, with six standard deviations to spare, so only about as many rows travel and are sorted; if that ever is too few,
    a second pass takes the stratum whole. Null is a stratum like any other. sizes: (by, _n), if they are known already.
    """
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in by]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")) if sizes is None else sizes
    if isinstance(want, int):
        sizes = sizes.withColumn("_want", F.lit(want))
    else:
        sizes = sizes.alias("r").join(want.alias("q"), same).select(*[F.col(f"r.{c}") for c in by], "_n", F.col("q.want").alias("_want"))
    share = (F.col("_want") + 6 * F.sqrt(F.col("_want").cast("double")) + 20) / F.col("_n")
    sizes = sizes.where("_want > 0").withColumn("_limit", F.when(share >= 1, F.lit(_ALL)).otherwise((share * _ALL).cast("long")))
    place = F.conv(F.substring(draw_key(seed, key), 1, 15), 16, 10).cast("long")

    def of(quotas: DataFrame, within: Column) -> DataFrame:
        found = rows.alias("r").join(quotas.alias("q"), same).where(within)
        return found.select("r.*", "q._want", "q._n")

    near = materialise(of(sizes, place <= F.col("_limit")), "draws")
    there = near.groupBy(*by).agg(F.count("*").alias("_there"))
    lacking = sizes.alias("r").join(there.alias("q"), same, "left").where(F.coalesce("q._there", F.lit(0)) < F.least("r._want", "r._n")).select("r.*")
    if not lacking.isEmpty():
        whole = of(lacking, F.lit(True))
        near = near.alias("r").join(lacking.alias("q"), same, "left_anti").unionByName(whole)
    return near.withColumn("_k", nth_in(by, [draw_key(seed, key), F.col(key)])).where(F.col("_k") <= F.col("_want")).drop("_want", "_n")


def round_robin(rows: DataFrame, strata: list[str], target: int, seed: int, key: str = "review_id") -> DataFrame:
    """Takes one row of each stratum in turn until there are `target`; small strata leave their share to the others.

    How many rows each turn has follows from the strata's sizes alone, so only the turns that are needed in full
    or in part are ranked, and the last turn is cut by the order of the strata.
    """
    total = rows.count()
    if not 0 < target <= total:
        raise ValueError(f"{target} rows of {total} can't be drawn")
    # After t turns each stratum has given t rows, or all: the last turn is the first by which there are `target`.
    found = {r.n: r.times for r in rows.groupBy(*strata).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("times")).collect()}
    low, high = 1, max(found)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sum(min(n, middle) * times for n, times in found.items()) >= target else (middle + 1, high)
    placed = drawn(rows, strata, low, seed, key).withColumnRenamed("_k", "_turn")
    return placed.orderBy("_turn", *strata).limit(target).drop("_turn")


def report(source: DataFrame, sampled: DataFrame, fields: list[str]) -> DataFrame:
    """Counts of source and sample by each field, and jointly (all fields set)."""
    both = source.select(*fields, F.lit(0).alias("s")).unionByName(sampled.select(*fields, F.lit(1).alias("s")))
    sets = [[f] for f in fields] + [fields]
    return both.groupingSets(sets, *fields).agg(F.count_if(F.col("s") == 0).alias("in_source"), F.count_if(F.col("s") == 1).alias("in_sample"))


def first_per_slice(rows: DataFrame, slices: list[str], n: int) -> DataFrame:
    return rows.withColumn("_n", nth_in(slices, [F.col("ord")])).where(F.col("_n") <= n).orderBy(*slices, "ord").drop("_n")


def quota_sample(rows: DataFrame, by: str, flag: Column, per_group: int, flagged: int, seed: int, key: str = "review_id") -> DataFrame:
    """Per group up to `flagged` rows with the flag, and the rest of the quota from those without."""
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    sizes = marked.where(F.col(by).isNotNull()).groupBy(by).agg(F.least(F.count_if("_flag"), F.lit(flagged)).alias("have"))
    wants = F.explode(F.array(F.struct(F.lit(True).alias("_flag"), F.col("have").alias("want")), F.struct(F.lit(False).alias("_flag"), (per_group - F.col("have")).alias("want"))))
    return drawn(marked, [by, "_flag"], sizes.select(by, wants.alias("w")).select(by, "w.*"), seed, key).drop("_flag", "_k")


def length_matched(rows: DataFrame, by: str, model_group: str, target: int, seed: int, key: str = "review_id", text: str = "text") -> DataFrame:
    """Every group drawn to the shape of one group's length buckets; a bucket with too few rows gives what it has."""
    bucketed = rows.withColumn("bucket", X.length_bucket(F.col(text)))
    sizes = materialise(bucketed.groupBy(by, "bucket").agg(F.count("*").alias("_n")), "strata")  # four a group at most
    own = sizes.where(F.col(by) == model_group)
    shape = own.withColumn("want", F.bround(target * F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1)))).cast("long")).select("bucket", "want")
    wants = sizes.select(by, "bucket").where(F.col(by).isNotNull()).join(F.broadcast(shape), "bucket").select(by, "bucket", "want")
    return drawn(bucketed, [by, "bucket"], wants, seed, key, sizes).drop("_k")


def random_per_group(rows: DataFrame, by: str, n: int, seed: int, key: str = "review_id") -> DataFrame:
    return drawn(rows, [by], n, seed, key).drop("_k")


def quotas(target: int, groups: tuple[str, ...] = K.LANGUAGES) -> dict[str, int]:
    """Even shares; the first groups get what is left over."""
    if target < len(groups):
        raise ValueError(f"{target} rows are fewer than {len(groups)} groups")
    base, rest = divmod(target, len(groups))
    return {g: base + (k < rest) for k, g in enumerate(groups)}


def audit_sample(rows: DataFrame, target: int, seed: int, groups: tuple[str, ...] = K.LANGUAGES, key: str = "review_id", by: str = "language", changed: Column | None = None, risky: Column | None = None) -> DataFrame:
    """Per group its quota: changed rows first, then rows with a risk cue, then others, each in random order."""
    share = quotas(target, groups)
    changed = (F.col("text_clean") != F.col("text_scrubbed")) if changed is None else changed
    risky = X.has_pii_risk_cue(F.col("text_clean")) if risky is None else risky
    rank = F.when(changed, 0).when(risky, 1).otherwise(2)
    marked = rows.withColumn("priority", rank)
    have: dict = {}
    for r in marked.groupBy(by, "priority").count().collect():  # three rows a group
        have.setdefault(r[0], {})[r[1]] = r[2]
    wants = []
    for g, n in share.items():
        sizes = have.get(g, {})
        if sum(sizes.values()) < n:
            raise ValueError(f"{n} rows of {g} are needed, {sum(sizes.values())} are there")
        for p in range(3):  # what those of higher priority leave
            wants.append((g, p, min(sizes.get(p, 0), n)))
            n -= wants[-1][2]
    return drawn(marked, [by, "priority"], rows.sparkSession.createDataFrame(wants, f"{by} string, priority int, want long"), seed, key).drop("_k")


def disputed_and_controls(rows: DataFrame, disputed: Column, control: Column, extra: int, seed: int, key: str = "review_id") -> DataFrame:
    """All disputed rows and `extra` random controls, in random order."""
    some = shuffled(rows.where(control & ~disputed), key, seed, extra) if extra else rows.limit(0)
    return shuffled(rows.where(disputed).unionByName(some), key, seed + 1)
