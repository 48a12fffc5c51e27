"""Slices of the corpus: filters that become one predicate, pages, and the aggregates of a report."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions import catalogue as K
from tallybrook.functions import text as X
from tallybrook.functions.stats import Z, pct, wilson

NO_KEY = "—"
PAGE = 40
LEAST_RELEASE = 40


def review_view(rows: DataFrame) -> DataFrame:
    """The explorer's columns with computed year, month and words; date is a string."""
    return rows.withColumns({"year": X.year(F.col("date")), "month": X.month(F.col("date")), "words": X.word_count(F.col("text"))})


@dataclass
class Filters:
    """Empty means no restriction; values of one facet are alternatives, facets and tags combine by AND."""

    platforms: set[str] = field(default_factory=set)
    products: set[str] = field(default_factory=set)
    ratings: set[int] = field(default_factory=set)
    languages: set[str] = field(default_factory=set)
    versions: set[str] = field(default_factory=set)
    years: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    tags: set[str] = field(default_factory=set)
    search: str = ""
    labelled_only: bool = False
    min_words: int = 0
    more: dict[str, set] = field(default_factory=dict)

    @classmethod
    def from_query(cls, query: str | dict[str, list[str]]) -> Filters:
        """A query string: repeated and comma-joined values; ratings that are no number are ignored."""
        q = parse_qs(query) if isinstance(query, str) else query

        def values(name: str) -> set[str]:
            return {v.strip() for part in q.get(name, []) for v in part.split(",") if v.strip()}

        words = next(iter(q.get("minwords", [])), "0")
        return cls(
            platforms=values("platform"), products=values("product"), ratings={int(v) for v in values("rating") if v.isdigit()}, languages=values("language"), versions=values("version"),
            years=values("year"), labels=values("label"), tags=values("tag"), search=next(iter(q.get("q", [])), "").strip(), labelled_only=next(iter(q.get("labelled", [])), "") in ("1", "true"), min_words=int(words) if words.isdigit() else 0,
        )

    def predicate(self, groups=K.KEYWORD_GROUPS) -> Column:
        """Cheap tests first: AND stops at the first that fails."""
        tests = [F.coalesce(F.col(name).isin(sorted(chosen)), F.lit(False)) for name, chosen in self._facets() if chosen]
        if self.labelled_only:
            tests.append(F.coalesce(F.col("label") != "", F.lit(False)))
        if self.min_words:
            tests.append(F.col("words") >= self.min_words)
        tests += [X.has_keyword(t, F.col("text"), groups) for t in sorted(self.tags)]
        if self.search:
            tests.append(F.contains(F.lower("text"), F.lit(self.search.lower())))
        return reduce(and_, tests, F.lit(True))

    def _facets(self):
        yield from (("platform", self.platforms), ("product", self.products), ("rating", self.ratings), ("language", self.languages), ("version", self.versions), ("year", self.years), ("label", self.labels))
        yield from self.more.items()


def select(rows: DataFrame, filters: Filters, groups=K.KEYWORD_GROUPS) -> DataFrame:
    return rows.where(filters.predicate(groups))


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("date"), "ord")


def page(rows: DataFrame, number: int = 0, size: int = PAGE) -> DataFrame:
    """A page past the end is empty."""
    return newest_first(rows).offset(number * size).limit(size)


def pages(rows: DataFrame, size: int = PAGE) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("pages"))


def values(rows: DataFrame, facet: str) -> DataFrame:
    text = F.col(facet).cast("string")
    return rows.select(text.alias("value")).where("value is not null and value <> ''").distinct().orderBy("value")


def breakdown(rows: DataFrame, by: str, limit: int = 20, bad: Column | None = None) -> DataFrame:
    """key, total, share, bad, bad_pct, low, high: the largest groups; ties by who came first."""
    bad = X.is_bad(F.col("rating")) if bad is None else bad
    key = F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit(NO_KEY))
    key = F.when(key == "0", NO_KEY).otherwise(key) if dict(rows.dtypes)[by] in ("int", "bigint", "smallint", "tinyint") else key
    groups = rows.groupBy(key.alias("key")).agg(F.count("*").alias("total"), F.sum(bad.cast("long")).alias("bad"), F.min("ord").alias("first_ord"))
    # One row per key is left, so a window over all of them is small; the slice's total is a sum of theirs.
    groups = groups.withColumn("slice", F.sum("total").over(Window.partitionBy(F.lit(1))))
    low, high = wilson(F.col("bad"), F.col("total"))
    out = groups.orderBy(F.desc("total"), "first_ord").limit(limit)
    return out.select("key", "total", pct(F.col("total"), F.col("slice")).alias("share"), "bad", pct(F.col("bad"), F.col("total")).alias("bad_pct"), F.bround(100 * low, 1).alias("low"), F.bround(100 * high, 1).alias("high"))


def releases(rows: DataFrame, least: int = LEAST_RELEASE, limit: int | None = PAGE, bad: Column | None = None, z: float = Z) -> DataFrame:
    """Versions of products with enough rows, worst first by the rounded share of bad rows; ties by who came first."""
    bad = X.is_bad(F.col("rating")) if bad is None else bad
    groups = rows.where("version is not null and version <> ''").groupBy("product", "version").agg(F.count("*").alias("total"), F.sum(bad.cast("long")).alias("bad"), F.min("ord").alias("first_ord"))
    low, high = wilson(F.col("bad"), F.col("total"), z)
    out = groups.where(F.col("total") >= least).withColumn("bad_pct", pct(F.col("bad"), F.col("total")))
    out = out.withColumns({"low": F.bround(100 * low, 1), "high": F.bround(100 * high, 1)}).orderBy(F.desc("bad_pct"), "first_ord")
    out = out if limit is None else out.limit(limit)
    return out.select("product", "version", "total", "bad", "bad_pct", "low", "high")


def trend(rows: DataFrame, months: int = 24, bad: Column | None = None) -> DataFrame:
    """The last months that have rows, oldest first."""
    bad = X.is_bad(F.col("rating")) if bad is None else bad
    groups = rows.where(F.length("month") == 7).groupBy("month").agg(F.count("*").alias("total"), F.sum(bad.cast("long")).alias("bad"))
    return groups.orderBy(F.desc("month")).limit(months).select("month", "total", "bad", pct(F.col("bad"), F.col("total")).alias("bad_pct")).orderBy("month")


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """median: the value at place n div 2, from 0, of the sorted values.

    By counts of each value: rows are combined before the exchange, and only distinct values are ordered.
    """
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    running = Window.partitionBy(F.lit(1)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(running), "all": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    return placed.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("v").alias("median"))


def summary(rows: DataFrame, corpus_size: int) -> DataFrame:
    """One row: total, share_of_corpus, bad_pct, labelled, labelled_pct, median_words, languages, first_month, last_month.

    An empty slice has total 0 and no labelled_pct.
    """
    month = F.when(F.length("month") == 7, F.col("month"))
    facts = rows.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(X.is_bad(F.col("rating")).cast("long")), F.lit(0)).alias("bad"),
        F.count_if(F.coalesce(F.col("label"), F.lit("")) != "").alias("labelled"),
        F.min(month).alias("first_month"),
        F.max(month).alias("last_month"),
    )
    langs = rows.groupBy("language").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    langs = langs.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o", "language", "n"))).alias("x")).select(F.transform("x", lambda e: F.struct(e["language"].alias("language"), e["n"].alias("n"))).alias("languages"))
    total = F.col("total")
    return facts.join(upper_median(rows, "words")).join(langs).select(
        "total",
        F.coalesce(pct(total, F.lit(corpus_size)), F.lit(0.0)).alias("share_of_corpus"),
        F.coalesce(pct(F.col("bad"), total), F.lit(0.0)).alias("bad_pct"),
        "labelled",
        pct(F.col("labelled"), total).alias("labelled_pct"),
        F.coalesce("median", F.lit(0)).cast("long").alias("median_words"),
        "languages",
        "first_month",
        "last_month",
    )


def label_mix(rows: DataFrame, limit: int = 15) -> DataFrame:
    """label, total, share of the labelled, human: the slice's human labels, on every row."""
    groups = rows.where("label is not null and label <> ''").groupBy("label").agg(F.count("*").alias("total"), F.min("ord").alias("first_ord"), F.count_if(F.col("label_source") == "human").alias("h"))
    every = Window.partitionBy(F.lit(1))
    groups = groups.withColumns({"of_labelled": F.sum("total").over(every), "human": F.sum("h").over(every)})
    return groups.orderBy(F.desc("total"), "first_ord").limit(limit).select("label", "total", pct(F.col("total"), F.col("of_labelled")).alias("share"), "of_labelled", "human")


def keyword_counts(rows: DataFrame, groups=K.KEYWORD_GROUPS) -> DataFrame:
    """tag, n: rows that hold each keyword group, in one pass."""
    counts = rows.agg(*[F.count_if(X.has_keyword(t, F.col("text"), groups)).alias(t) for t, _, _ in groups])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).alias("n")) for t, _, _ in groups])).alias("e")).select("e.*")


def describe_keywords(spark, groups=K.KEYWORD_GROUPS) -> DataFrame:
    return spark.createDataFrame([(t, d) for t, d, _ in groups], "id string, label string")


def export_rows(rows: DataFrame) -> DataFrame:
    """A slice for judging: id, text and six facts, never a label or a prediction."""
    meta = F.create_map(*[x for k, c in (("platform", "platform"), ("product", "product"), ("rating", "rating"), ("language", "language"), ("date", "date"), ("version", "version")) for x in (F.lit(k), (F.substring("date", 1, 10) if c == "date" else F.col(c)).cast("string"))])
    return rows.select("id", "text", meta.alias("meta"))


def display_json(rows: DataFrame) -> DataFrame:
    """id, json: a review as the explorer shows it."""
    shown = ("id", "text", "platform", "product", "rating", "language", "date", "version", "label", "label_source")
    return rows.select("id", F.to_json(F.struct(*[c for c in shown if c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


class Report:
    """A filtered slice and all that an answer shows of it; the slice is read once and kept."""

    def __init__(self, rows: DataFrame, filters: Filters, number: int = 0):
        self.corpus = rows
        self.slice = select(rows, filters).persist()
        self.number = number

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *_) -> None:
        self.slice.unpersist()

    def tables(self) -> dict[str, DataFrame]:
        s = self.slice
        return {
            "summary": summary(s, self.corpus.count()),
            "page": page(s, self.number),
            "pages": pages(s),
            "by_product": breakdown(s, "product"),
            "by_language": breakdown(s, "language"),
            "by_rating": breakdown(s, "rating"),
            "by_year": breakdown(s, "year", 15),
            "releases": releases(s),
            "trend": trend(s),
            "labels": label_mix(s),
        }
