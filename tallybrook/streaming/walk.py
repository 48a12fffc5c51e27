"""A walk over an app's pages, newest first, as a stateful operator: what is new, and why the walk ends.

State of an app: the ids that its walk has seen (a map, which the state store keeps on disk), the run of known reviews,
the pages fetched, and the reason once the walk has ended. What was known before the walk is marked by a join, where no
app's ids meet. Pages are whole within a batch and ascend from batch to batch, as sources/paged.py gives them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A row for each new review, and one with the reason (and neither page, place nor review) when the walk ends.
WALKED = "app_id string, page long, place long, review string, stop_reason string, pages_fetched long, new_rows long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Walk(StatefulProcessor):
    def __init__(self, threshold: int, max_pages: int):
        self.threshold, self.max_pages = threshold, max_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", T.StructType([T.StructField("review_id", T.StringType())]), T.StructType([T.StructField("known", T.BooleanType())]))
        fields = [T.StructField(c, T.LongType()) for c in ("run", "pages", "new_rows")]
        self.walk = handle.getValueState("walk", T.StructType([*fields, T.StructField("reason", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        run, pages, new_rows, reason = self.walk.get() if self.walk.exists() else (0, 0, 0, None)
        if reason is not None:  # ended in an earlier batch
            return
        by_page: dict[int, list[Row]] = {}
        seen: set[str] = set()
        for row in rows:  # a batch's pages of one app, which the source bounds
            by_page.setdefault(row.page, []).append(row)
        for page in sorted(by_page):
            if pages >= self.max_pages:
                break
            pages += 1
            own = sorted((r for r in by_page[page] if r.place is not None), key=lambda r: r.place)
            for row in own:
                if row.known or row.review_id in seen or self.known.containsKey((row.review_id,)):
                    run += 1
                    continue
                seen.add(row.review_id)
                self.known.updateValue((row.review_id,), (True,))
                run, new_rows = 0, new_rows + 1
                yield Row(app_id=key[0], page=page, place=row.place, review=row.review, stop_reason=None, pages_fetched=None, new_rows=None)
            if not own:
                reason = "store_exhausted"
            elif run >= self.threshold:
                reason = "caught_up"
            elif not by_page[page][0].more:
                reason = "store_exhausted"
            elif pages >= self.max_pages:
                reason = "max_pages"
            if reason is not None:
                yield Row(app_id=key[0], page=None, place=None, review=None, stop_reason=reason, pages_fetched=pages, new_rows=new_rows)
                break
        self.walk.update((run, pages, new_rows, reason))

    def close(self) -> None:
        pass


def walk(pages: DataFrame, known: DataFrame, threshold: int = 100, max_pages: int = 25) -> DataFrame:
    """WALKED for pages (app_id, page, place, review_id, review, more; an empty page is a row without a place), a stream or a table.

    known: (app_id, review_id) of all that was there before the walk. A null id is an id like any other. `more`: whether the store
    has a page after this one. An app's rows of a batch go to one task, which stops at max_pages; of a table, pages beyond these
    don't go there (a stream's source bounds them).
    """
    use_rocksdb(pages.sparkSession)
    if not pages.isStreaming:
        pages = _first_pages(pages, max_pages)
    ident = F.coalesce(F.col("review_id").cast("string"), F.lit("None")).alias("review_id")
    held = known.select("app_id", ident, F.lit(True).alias("known")).distinct()
    rows = pages.select("app_id", "page", "place", ident, "review", "more").join(held, ["app_id", "review_id"], "left")
    return rows.groupBy("app_id").transformWithState(Walk(threshold, max_pages), WALKED, "Append", "None")


def _first_pages(pages: DataFrame, most: int) -> DataFrame:
    """The rows of each app's first pages. Only a row a page meets in the ranking; a null app is one like any other."""
    first = pages.select("app_id", "page").distinct().withColumn("_at", F.row_number().over(Window.partitionBy("app_id").orderBy("page"))).where(F.col("_at") <= most)
    last = first.groupBy("app_id").agg(F.max("page").alias("_last")).select(F.col("app_id").alias("_app"), "_last")
    return pages.join(last, F.col("app_id").eqNullSafe(F.col("_app")) & (F.col("page").isNull() | (F.col("page") <= F.col("_last")))).drop("_app", "_last")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that map state needs; it counts for streams that start after this. The manager of streams has its coordinator."""
    _ = spark.streams.active
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
