"""Cleaning: drop reasons, product remap, and order-dependent de-duplication on two keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook import schemas
from tallybrook.functions import text as X
from tallybrook.sources.shared import discard, materialise


def first_wins(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first record of each key. Records of a key are combined before the exchange, so its copies don't gather."""
    return df.groupBy(key).agg(F.min_by(F.struct("*"), F.col(order)).alias("r")).select("r.*")


def last_wins(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The last record of each key, with `first_ord`, the place of the first."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), F.col(order)).alias("r"), F.min(order).alias("first_ord")).select("r.*", "first_ord")


#: Rows that are left in two_key_dedup() and are few enough to be taken in order by one task.
FEW = 200_000


def two_key_dedup(df: DataFrame, identity: str, content: str, order: str = "ord") -> DataFrame:
    """df with `verdict`: kept, duplicate_id or duplicate_text; as if rows were taken in order, and a row kept
    unless a kept one has its identity (tested first) or its content. Rejected rows reserve nothing.

    Which rows are kept is found by first_matching(), in a few rounds. `order` is unique.
    """

    def known(key: str):  # null is a key like any other
        return F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))

    rows = df.select(known(identity).alias("i"), known(content).alias("c"), F.col(order).alias("o"))
    kept, _ = first_matching(rows)
    # Which key a row is rejected by is known when all kept rows are.
    ids = kept.select(F.col("i").alias("_i"), F.col("o").alias("_kept"))
    verdict = F.when(F.col("_kept") == F.col(order), "kept").when(F.col("_kept") < F.col(order), "duplicate_id").otherwise("duplicate_text")
    return df.join(ids, known(identity) == F.col("_i"), "left").withColumn("verdict", verdict).drop("_i", "_kept")


def first_matching(rows: DataFrame, few: int | None = None) -> tuple[DataFrame, int]:
    """The rows (i, c, o) that are kept if rows are taken in the order of o, each unless a kept one has its i or its c; and the rounds that took.

    Rows of one (i, c) are as their first. A row waits for the rows before it that share a key. One that waits for none is kept. One that
    waits for a single row is kept if that one is not, so along a chain of such rows every other one is kept: pointers are doubled until
    each reaches the chain's end, in as many rounds as the logarithm of its length. What is kept takes all rows of its keys out, and the
    rest goes on. Once at most `few` rows are left, one task takes them in order.

    Keys meet by minima, which are combined before the exchange, and rows by their unique o. Tables are in the shared folder, and are
    removed when the next one has replaced them.
    """
    few = FEW if few is None else few
    rest = materialise(rows.groupBy("i", "c").agg(F.min("o").alias("o")), "rows")
    kept, rounds = rows.limit(0), 0
    while n := rest.count():
        if n <= few:
            last = materialise(rest.repartition(1).sortWithinPartitions("o").mapInPandas(_in_order, rest.schema), "kept")
            discard(rest)
            return kept.unionByName(last), rounds + 1
        first = {k: rest.groupBy(k).agg(F.min("o").alias("o")) for k in "ic"}
        firsts = {k: materialise(f, "firsts") for k, f in first.items()}
        ends = firsts["i"].select("o").join(firsts["c"].select("o"), "o").select("o", F.lit(None).cast(dict(rest.dtypes)["o"]).alias("to"), F.lit(False).alias("odd"))
        chains = ends
        for k, other in (("i", "c"), ("c", "i")):  # second of one key, first of the other: it waits for one row
            second = rest.join(firsts[k].select("o"), "o", "left_anti").groupBy(k).agg(F.min("o").alias("o"))
            waits = second.join(firsts[k].withColumnRenamed("o", "to"), k).select("o", "to", F.lit(True).alias("odd"))
            chains = chains.unionByName(waits.join(firsts[other].select("o"), "o", "left_semi"))
        chains = materialise(chains, "chains")
        rounds += 1
        while True:
            by = chains.select(F.col("o").alias("to"), F.col("to").alias("_next"), F.col("odd").alias("_odd"))
            moved = chains.where("to is not null").join(by, "to").select("o", F.col("_next").alias("to"), (F.col("odd") != F.col("_odd")).alias("odd"), F.lit(True).alias("moved"))
            stuck = chains.where("to is not null").join(by, "to", "left_anti").unionByName(chains.where("to is null"))
            after = materialise(moved.unionByName(stuck.withColumn("moved", F.lit(False))), "chains")
            discard(chains)
            chains, rounds = after.drop("moved"), rounds + 1
            chains._tallybrook_path = after._tallybrook_path
            if after.where("moved and to is not null").isEmpty():
                break
        held = materialise(rest.join(chains.where("to is null and not odd").select("o"), "o", "left_semi"), "kept")
        after = materialise(rest.join(held.select("i"), "i", "left_anti").join(held.select("c"), "c", "left_anti"), "rows")
        discard(rest, chains, *firsts.values())
        rest, kept = after, kept.unionByName(held)
    discard(rest)
    return kept, rounds


def _in_order(batches):
    """Rows in the order of o, each unless a kept one has its i or c; the keys of what is kept are all that is held."""
    ids, contents = set(), set()
    for frame in batches:
        keep = []
        for i, c in zip(frame["i"], frame["c"], strict=True):
            keep.append(i not in ids and c not in contents)
            if keep[-1]:
                ids.add(i)
                contents.add(c)
        yield frame[keep]


def remap_products(reviews: DataFrame, registry: DataFrame) -> DataFrame:
    """product_id by (platform, platform_app_id) of the registry; unknown listings keep theirs, null becomes empty."""
    dim = registry.select("platform", "platform_app_id", F.col("product_id").alias("_mapped")).dropDuplicates(["platform", "platform_app_id"])
    return reviews.join(dim, ["platform", "platform_app_id"], "left").withColumn("product_id", F.coalesce("_mapped", "product_id", F.lit(""))).drop("_mapped")


def clean(reviews: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows of CLEAN_FIELDS and ord, drop reasons with counts) of raw reviews with `ord`."""
    rows = reviews if registry is None else remap_products(reviews, registry)
    rows = rows.withColumn("text_clean", X.normalise(F.col("text"))).withColumn("reason", X.drop_reason(F.col("text_clean")))
    good = rows.where("reason is null").withColumn("text_hash", X.text_hash(F.col("text_clean")))
    identity = F.concat_ws("\u0000", F.coalesce("platform", F.lit("None")), F.coalesce("review_id", F.lit("None")))
    judged = two_key_dedup(good.withColumn("_identity", identity), "_identity", "text_hash")
    dropped = rows.where("reason is not null").select("reason").unionByName(judged.where("verdict <> 'kept'").select(F.col("verdict").alias("reason")))
    kept = judged.where("verdict = 'kept'").withColumn("language", X.language(F.col("text_clean"))).select(*schemas.CLEAN_FIELDS, "ord")
    return kept, dropped.groupBy("reason").agg(F.count("*").alias("n"))


def report(cleaned: DataFrame) -> DataFrame:
    """Counts by language, platform, product, and in all, with the window of dates."""
    sets = cleaned.groupingSets([["language"], ["platform"], ["product_id"], []], "language", "platform", "product_id")
    return sets.agg(F.count("*").alias("n"), F.min(F.substring("timestamp", 1, 10)).alias("first_day"), F.max(F.substring("timestamp", 1, 10)).alias("last_day"))


def validate_raw(reviews: DataFrame, by: tuple[str, ...] = ("platform", "product_id")) -> DataFrame:
    """Per listing: records, duplicates (records less distinct ids that are not empty), empty texts, ratings, window, scripts."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")
    kind = F.when(text == "", "empty").otherwise(X.script(text))
    return reviews.groupBy(*by).agg(
        F.count("*").alias("records"),
        (F.count("*") - F.countDistinct(F.nullif("review_id", F.lit("")))).alias("duplicates"),
        F.count_if(text == "").alias("empty_texts"),
        *[F.count_if(F.col("rating") == k).alias(f"rating_{k}") for k in range(1, 6)],
        F.min(F.nullif("timestamp", F.lit(""))).alias("earliest"),
        F.max(F.nullif("timestamp", F.lit(""))).alias("latest"),
        *[F.count_if(kind == s).alias(f"script_{s}") for s in ("latin", "urdu_script", "mixed", "empty")],
    )


def attach_brand(rows: DataFrame, registry: DataFrame) -> DataFrame:
    brands = registry.groupBy("product_id").agg(F.min("brand_group").alias("brand_group"))
    return rows.join(brands, "product_id", "left").withColumn("brand_group", F.coalesce("brand_group", F.lit("Unknown")))


def census(listings: DataFrame, reviews: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Every listing with its observed reviews (0 if none), and store metadata where there is some."""
    at = X.timestamp(F.col("timestamp"))
    seen = reviews.groupBy("platform", "platform_app_id").agg(F.count("*").alias("observed"), F.min(at).alias("earliest"), F.max(at).alias("latest"), *[F.count_if(F.col("rating") == k).alias(f"rating_{k}") for k in range(1, 6)])
    out = listings.join(seen, ["platform", "platform_app_id"], "left").fillna(0, ["observed", *[f"rating_{k}" for k in range(1, 6)]])
    return out if metadata is None else out.join(metadata, ["platform", "platform_app_id"], "left")


def header_totals(listings: DataFrame) -> DataFrame:
    """A report's header: products, listings, core products, listings to be confirmed, observed reviews (null as 0)."""
    observed = F.sum(F.coalesce("observed", F.lit(0))) if "observed" in listings.columns else F.lit(0).cast("long")
    return listings.agg(
        F.countDistinct("product_id").alias("products"), F.count("*").alias("listings"), F.countDistinct(F.when(F.col("inclusion_tier") == "core", F.col("product_id"))).alias("core_products"),
        F.count_if(~F.coalesce("confirmed", F.lit(False))).alias("pending"), F.coalesce(observed, F.lit(0)).alias("observed"),
    )
