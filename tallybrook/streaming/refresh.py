"""Incremental refresh: landed pages stream in, unseen reviews are kept, judgements are upserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallybrook import schemas
from tallybrook.functions import text as X
from tallybrook.operators.clean import first_wins
from tallybrook.sources.paged import stream_pages
from tallybrook.streaming.walk import walk


def known_ids(*trees: DataFrame, key: tuple[str, ...] = ("platform", "review_id")) -> DataFrame:
    """Ids over the original rows and all refreshed ones."""
    out = trees[0].select(*key)
    for t in trees[1:]:
        out = out.unionByName(t.select(*key))
    return out.distinct()


def caught_up(pages: DataFrame, by: str, page: str, order: str, known: Column, threshold: int = 100) -> DataFrame:
    """by, page, last_run, stops: the run of known rows at each page's end, and whether it has reached the threshold there.

    A run begins anew after each unknown row, and goes on over pages, which are in the order of their rows. Rows meet
    within their page only; what goes on is a row a page.
    """
    own = Window.partitionBy(by, page)  # a page is of bounded size
    last = F.max(F.when(~known, F.col(order))).over(own)
    rows = pages.select(by, page, last.alias("_last"), F.col(order).alias("_at"))
    sizes = rows.groupBy(by, page).agg(F.count_if(F.col("_last").isNull() | (F.col("_at") > F.col("_last"))).alias("_tail"), F.max(F.col("_last").isNotNull()).cast("int").alias("_breaks"))
    run = F.sum("_breaks").over(Window.partitionBy(by).orderBy(page))  # a row a page
    within = Window.partitionBy(by, "_run").orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.withColumn("_run", run).select(by, page, F.sum("_tail").over(within).alias("last_run"))
    return ends.withColumn("stops", F.col("last_run") >= threshold)


def first_sights(pages: DataFrame, by: str, ident: str, order: str, known: Column) -> DataFrame:
    """pages with `new`: the id was not known, and this is its first place in the walk. A null id is an id like any other.

    Places meet by minima, which are combined before the exchange; a walk's rows don't gather.
    """
    name = F.coalesce(F.col(ident).cast("string"), F.lit("None"))
    firsts = pages.where(~known).groupBy(by, name.alias("_id")).agg(F.min(order).alias(order)).select(by, order, F.lit(True).alias("new"))
    return pages.join(firsts, [by, order], "left").withColumn("new", F.coalesce("new", F.lit(False)))


def stop_reasons(pages: DataFrame, by: str, page: str, order: str, known: Column, ident: str, threshold: int = 100, max_pages: int = 25, tokens: DataFrame | None = None) -> DataFrame:
    """by, pages_fetched, new_rows, stop_reason of walks over pages from the newest (page 0).

    A walk ends after the first page that has no rows (store_exhausted), ends in a run of `threshold` known rows (caught_up), or
    has no next one (store_exhausted); or after max_pages. Ids that a walk has met are known to it from then on. tokens: (by,
    page, more), a row for each page, those without rows too; without it the last page with rows has no next one.
    """
    rows = first_sights(pages, by, ident, order, known)
    ends = caught_up(rows, by, page, order, ~F.col("new"), threshold)
    fresh = rows.groupBy(by, page).agg(F.count_if("new").alias("_new"))
    if tokens is None:
        last = F.max(page).over(Window.partitionBy(by))  # a row a page
        tokens = fresh.select(by, page, (F.col(page) < last).alias("more"))
    else:
        tokens = tokens.select(by, page, "more")
    reason = F.when(F.col("stops").isNull(), "store_exhausted").when(F.col("stops"), "caught_up").when(~F.col("more"), "store_exhausted")
    walked = tokens.where(F.col(page) < max_pages).join(ends, [by, page], "left").join(fresh, [by, page], "left").withColumn("_reason", reason)
    before = Window.partitionBy(by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    walked = walked.withColumn("_ended", F.count("_reason").over(before)).where("_ended = 0")
    return walked.groupBy(by).agg(
        F.count("*").alias("pages_fetched"), F.coalesce(F.sum("_new"), F.lit(0)).alias("new_rows"), F.coalesce(F.max("_reason"), F.lit("max_pages")).alias("stop_reason")
    )


def readable(rows: DataFrame) -> DataFrame:
    """Refreshed rows as they are read: text normalised, of three words or more by white space, its language told from it."""
    good = rows.withColumn("text", X.normalise(F.col("text"))).where(X.has_words(F.col("text"), 3))
    return good.withColumn("language", X.language(F.col("text")))


def admit(rows: DataFrame, known: DataFrame, key: tuple[str, ...] = ("platform", "review_id")) -> DataFrame:
    """Unseen rows whose normalised text has three words or more, by white space; the first of each id."""
    good = rows.withColumn("text_clean", X.normalise(F.col("text"))).where(X.has_words(F.col("text_clean"), 3))
    return good.dropDuplicates(list(key)).join(known, list(key), "left_anti")


def refresh_stream(spark: SparkSession, root: str, refreshed: str, checkpoint: str, known: DataFrame, run_date: str, threshold: int = 100, max_pages: int = 25) -> StreamingQuery:
    """Walks over landed pages (see sources/paged.py); every unseen row goes to refreshed/rows/run_date=.../batch=..., why a walk ended to refreshed/walks/...

    known: (app_id, review_id) of what was collected otherwise; rows of earlier runs are known, too. Short texts are written as
    well: they are left out where they are read (readable()), and so are not collected again. A batch that is run
    again writes the same folders anew.
    """
    earlier = read_refreshed(spark, refreshed).where(F.col("run_date") != run_date).select("app_id", "review_id")
    walked = walk(stream_pages(spark, root, max_pages=max_pages), known.select("app_id", "review_id").unionByName(earlier), threshold, max_pages)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        rows = held.where("stop_reason is null").select("app_id", "page", "place", F.from_json("review", schemas.REVIEW).alias("r")).select("app_id", "page", "place", "r.*")
        rows.write.mode("overwrite").parquet(f"{refreshed}/rows/run_date={run_date}/batch={number}")
        held.where("stop_reason is not null").select("app_id", "stop_reason", "pages_fetched", "new_rows").write.mode("overwrite").parquet(f"{refreshed}/walks/run_date={run_date}/batch={number}")
        held.unpersist()

    return walked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_REFRESHED = T.StructType([*schemas.of("app_id STRING, page LONG, place LONG").fields, *schemas.REVIEW.fields, *schemas.of("run_date STRING, batch INT").fields])
_WALKS = schemas.of("app_id STRING, stop_reason STRING, pages_fetched LONG, new_rows LONG, run_date STRING, batch INT")


def read_refreshed(spark: SparkSession, refreshed: str, what: str = "rows") -> DataFrame:
    """All rows (or `walks`) that refresh_stream() wrote; none where nothing is."""
    schema = _REFRESHED if what == "rows" else _WALKS
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{refreshed}/{what}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{refreshed}/{what}")


def with_refresh(corpus: DataFrame, refreshed: DataFrame) -> DataFrame:
    """The cleaned corpus (its text is text_clean, if it has that) and refreshed rows as readable() gives them; of one id the first row stays.

    Both have ord; refreshed rows come after. Rows without an id, or with an empty one, are left out.
    """
    text = F.coalesce(F.nullif("text_clean", F.lit("")), "text") if "text_clean" in corpus.columns else F.col("text")
    both = corpus.withColumn("text", text).withColumn("_at", F.struct(F.lit(0).alias("late"), "ord")).unionByName(readable(refreshed).withColumn("_at", F.struct(F.lit(1).alias("late"), "ord")), allowMissingColumns=True)
    return first_wins(both.where(F.coalesce(F.col("review_id").cast("string"), F.lit("")) != ""), "review_id", "_at").drop("_at")


def latest_stream(spark: SparkSession, log: str, schema, target: str, checkpoint: str, keys: tuple[str, ...] = ("item_id",)) -> StreamingQuery:
    """Follows an append-only log of judgements; the table at target (see sources/bucketed.py) holds the last record of each key."""
    from tallybrook.sources.bucketed import Bucketed

    table = Bucketed(spark, target, schema, keys)
    return spark.readStream.schema(schema).json(log).writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_stream(rows: DataFrame, at: str = "ts", late: str = "7 days", bad: Column | None = None) -> DataFrame:
    """A streaming trend by day of event time, with late rows up to the watermark. An addition: the batch trend goes by strings."""
    bad = X.is_bad(F.col("rating")) if bad is None else bad
    counted = rows.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("total"), F.sum(bad.cast("long")).alias("bad"))
    return counted.select(F.col("w.start").alias("day"), "total", "bad")
