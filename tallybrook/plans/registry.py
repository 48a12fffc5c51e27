"""The engine's operators over the driver's tables, with equivalent SQL.

`documents` stands in for reviews: the adapters below give each side the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.functions import parsing, pii
from tallybrook.functions import stats as S
from tallybrook.functions import text as X
from tallybrook.operators import clean as CL
from tallybrook.operators import facets, labels, sampling, scoring, studies, worklists
from tallybrook.operators import titles as similar
from tallybrook.sources import reviews as R
from tallybrook.streaming import refresh

QUERIES: dict = {}
SQL: dict[str, str] = {}
SEED = 20260817
#: English test catalogues: the corpus is invented prose, so its own common words stand for keywords.
TAGS = (("time", "when", r"\b(was|then|when|from)\b"), ("licence", "licence lines", r"\b(license|licensed|public|rights)\b"), ("token", "secrets", r"\b(token|password|secret)\b"))
SIGNALS = {"articles": (r"\bthe\b", r"\ba\b"), "secrets": (r"\btoken\b", r"\b[0-9a-f]{40}\b"), "licence": (r"licen[sc]ed?", r"public")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- adapters

def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    month = F.lpad((F.col("doc_id") % 30 % 12 + 1).cast("string"), 2, "0")
    date = F.concat((2022 + F.col("doc_id") % 3).cast("string"), F.lit("-"), month, F.lit("-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    return d.select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 3 == 0, "apple_app_store").otherwise("google_play").alias("platform"),
        F.col("source").alias("product"),
        "text",
        F.col("lang").alias("language"),
        (1 + F.col("doc_id") % 5).cast("int").alias("rating"),
        F.concat(F.lit("1."), (F.col("doc_id") % 8).cast("string")).alias("version"),
        date.alias("date"),
    )


REVIEWS = """reviews AS (
  SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'apple_app_store' ELSE 'google_play' END AS platform,
         source AS product, text, lang AS language, CAST(1 + doc_id % 5 AS INTEGER) AS rating, '1.' || CAST(doc_id % 8 AS VARCHAR) AS version,
         CAST(2022 + doc_id % 3 AS VARCHAR) || '-' || lpad(CAST(doc_id % 30 % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date
  FROM documents)"""
#: White space of the driver's texts is ASCII, so these agree with the engine's Unicode classes.
WORDS = "len(list_filter(regexp_split_to_array({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"


def sql_pct(hits: str, total: str) -> str:
    return f"round_even(100.0 * {hits} / NULLIF({total}, 0), 1)"


def sql_wilson(hits: str, total: str, z: float = S.Z) -> tuple[str, str]:
    h, n = f"CAST({hits} AS DOUBLE)", f"CAST({total} AS DOUBLE)"
    p, below = f"({h} / {n})", f"(1.0 + {z * z!r} / {n})"
    centre = f"(({p} + {z * z!r} / (2 * {n})) / {below})"
    half = f"({z!r} * sqrt({p} * (1 - {p}) / {n} + {z * z!r} / (4 * {n} * {n})) / {below})"
    ends = (f"greatest(0.0, {centre} - {half})", f"least(1.0, {centre} + {half})")
    return tuple(f"CASE WHEN {total} = 0 THEN 0.0 ELSE round_even(100 * {e}, 1) END" for e in ends)


LOW, HIGH = sql_wilson("bad", "total")
BAD = "CAST(sum(CASE WHEN coalesce(nullif(rating, 0), 5) <= 2 THEN 1 ELSE 0 END) AS BIGINT)"


# ---- explorer


@query(
    f"""WITH g AS (
  SELECT p_brand AS product, p_type AS version, count(*) AS total, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS bad, min(l_orderkey * 8 + l_linenumber) AS first_ord
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IS NOT NULL AND p_type <> '' GROUP BY 1, 2 HAVING count(*) >= 40)
SELECT product, version, total, bad, {sql_pct("bad", "total")} AS bad_pct, {LOW} AS low, {HIGH} AS high FROM g ORDER BY bad_pct DESC, first_ord LIMIT 40"""
)
def release_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("p_brand").alias("product"), F.col("p_type").alias("version"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), "l_returnflag")
    return facets.releases(rows, bad=F.col("l_returnflag") == "R")


@query(
    f"""WITH g AS (
  SELECT coalesce(nullif(o_orderpriority, ''), '—') AS key, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS bad, min(o_orderkey) AS first_ord FROM orders GROUP BY 1),
s AS (SELECT *, sum(total) OVER () AS slice FROM g)
SELECT key, total, {sql_pct("total", "slice")} AS share, bad, {sql_pct("bad", "total")} AS bad_pct, {LOW} AS low, {HIGH} AS high FROM s ORDER BY total DESC, first_ord LIMIT 20"""
)
def breakdown_priority(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("ord", F.col("o_orderkey"))
    return facets.breakdown(rows, "o_orderpriority", bad=F.col("o_orderstatus") == "F")


@query(
    f"""WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM orders GROUP BY 1)
SELECT month, total, bad, {sql_pct("bad", "total")} AS bad_pct FROM (SELECT * FROM g ORDER BY month DESC LIMIT 24) ORDER BY month"""
)
def trend_24m(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return facets.trend(rows, bad=F.col("o_orderstatus") == "F")


@query(
    f"""WITH {REVIEWS}, s AS (SELECT *, {WORDS.format("text")} AS words FROM reviews WHERE platform = 'google_play'),
langs AS (SELECT string_agg(language || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, o) AS languages FROM (SELECT language, count(*) AS n, min(ord) AS o FROM s GROUP BY 1)),
med AS (SELECT words FROM (SELECT words, row_number() OVER (ORDER BY words) AS k, count(*) OVER () AS n FROM s) WHERE k = n // 2 + 1)
SELECT count(*) AS total, {sql_pct("count(*)", "(SELECT count(*) FROM reviews)")} AS share_of_corpus, {sql_pct(BAD, "count(*)")} AS bad_pct,
       count(*) FILTER (WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)) AS labelled, {sql_pct("count(*) FILTER (WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels))", "count(*)")} AS labelled_pct,
       CAST((SELECT words FROM med) AS BIGINT) AS median_words, (SELECT languages FROM langs) AS languages, min(date[1:7]) AS first_month, max(date[1:7]) AS last_month FROM s"""
)
def slice_summary(spark, sf_dir):
    rows = facets.review_view(labelled(spark, sf_dir))
    out = facets.summary(facets.select(rows, facets.Filters(platforms={"google_play"})), rows.count())
    return out.withColumn("languages", F.array_join(F.transform("languages", lambda e: F.concat(e["language"], F.lit("="), e["n"].cast("string"))), ","))


def labelled(spark, sf_dir):
    """Reviews with labels: quality is the models' label, toxic the person's, for toxic rows."""
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("review_id"), "quality", "toxic", F.col("doc_id").alias("ord"))
    model = own.select("review_id", F.concat(F.lit("quality_"), F.col("quality").cast("string")).alias("label"), "ord")
    human = own.where("toxic = 1").select("review_id", F.lit("toxic").alias("label"), (F.col("ord") % 5 == 0).alias("skipped"), "ord")
    return labels.attach_labels(reviews(spark, sf_dir), labels.resolve_labels(model, human), "id")


@query(
    f"""WITH {REVIEWS}, own AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 AND doc_id % 5 <> 0 THEN 'toxic' ELSE 'quality_' || CAST(quality AS VARCHAR) END AS label, CASE WHEN toxic = 1 AND doc_id % 5 <> 0 THEN 1 ELSE 0 END AS human FROM labels),
g AS (SELECT label, count(*) AS total, min(ord) AS first_ord, sum(human) AS h FROM reviews JOIN own USING (id) GROUP BY 1)
SELECT label, total, {sql_pct("total", "sum(total) OVER ()")} AS share, CAST(sum(total) OVER () AS BIGINT) AS of_labelled, CAST(sum(h) OVER () AS BIGINT) AS human FROM g ORDER BY total DESC, first_ord LIMIT 15"""
)
def label_mix(spark, sf_dir):
    return facets.label_mix(labelled(spark, sf_dir))


_TAG_SQL = "regexp_matches(text, '(?i)\\b(was|then|when|from)\\b') AND contains(lower(text), 'the')"


@query(
    f"""WITH {REVIEWS} SELECT id, product, rating, date FROM reviews
WHERE platform IN ('google_play') AND rating IN (1, 2, 3) AND language IN ('en') AND {WORDS.format("text")} >= 5 AND {_TAG_SQL} ORDER BY date DESC, ord LIMIT 40 OFFSET 40"""
)
def facet_page(spark, sf_dir):
    filters = facets.Filters.from_query("platform=google_play&rating=1,2,banana&rating=3&language=en&tag=time&minwords=5&q=THE")
    found = facets.select(facets.review_view(reviews(spark, sf_dir)), filters, TAGS)
    return facets.page(found, 1).select("id", "product", "rating", "date")


@query(f"WITH {REVIEWS} SELECT DISTINCT product AS value FROM reviews WHERE product IS NOT NULL AND product <> '' ORDER BY 1")
def facet_values(spark, sf_dir):
    return facets.values(reviews(spark, sf_dir), "product")


@query(
    f"""WITH {REVIEWS} SELECT tag, CAST(n AS BIGINT) AS n FROM (
  SELECT 'time' AS tag, count(*) FILTER (WHERE regexp_matches(text, '(?i)\\b(was|then|when|from)\\b')) AS n FROM reviews
  UNION ALL SELECT 'licence', count(*) FILTER (WHERE regexp_matches(text, '(?i)\\b(license|licensed|public|rights)\\b')) FROM reviews
  UNION ALL SELECT 'token', count(*) FILTER (WHERE regexp_matches(text, '(?i)\\b(token|password|secret)\\b')) FROM reviews)"""
)
def keyword_tags(spark, sf_dir):
    # RE2's word border is ASCII; texts with letters beyond it next to a keyword don't occur with these words.
    return facets.keyword_counts(reviews(spark, sf_dir), TAGS)


@query(f"WITH {REVIEWS} SELECT id, text, platform, product, CAST(rating AS VARCHAR) AS rating, language, date, version FROM reviews WHERE rating = 1")
def export_slice(spark, sf_dir):
    out = facets.export_rows(facets.select(reviews(spark, sf_dir), facets.Filters(ratings={1})))
    return out.select("id", "text", *[F.col("meta")[k].alias(k) for k in ("platform", "product", "rating", "language", "date", "version")])


# ---- cleaning

_CLEAN_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '<[^>]+>', ' ', 'g'), chr(160), ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_TOKENS_SQL = "len(regexp_extract_all({0}, '[A-Za-z0-9\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}\\x{{FB50}}-\\x{{FDFF}}\\x{{FE70}}-\\x{{FEFF}}]+'))"
_REASON_SQL = f"CASE WHEN t = '' THEN 'empty' WHEN {_TOKENS_SQL.format('t')} = 0 THEN 'emoji_only' WHEN {_TOKENS_SQL.format('t')} < 3 THEN 'too_short' ELSE 'kept' END"


@query(
    f"""WITH u AS (SELECT html AS x FROM pages UNION ALL SELECT text FROM documents), c AS (SELECT {_CLEAN_SQL.format("x")} AS t FROM u)
SELECT {_REASON_SQL} AS reason, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum({_TOKENS_SQL.format("t")}) AS BIGINT) AS tokens FROM c GROUP BY 1"""
)
def normalise_drop(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("html").alias("x")).unionByName(table(spark, sf_dir, "documents").select(F.col("text").alias("x")))
    rows = rows.select(X.normalise(F.col("x")).alias("t"))
    reason = F.coalesce(X.drop_reason(F.col("t")), F.lit("kept"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"), F.sum(X.token_count(F.col("t"))).cast("long").alias("tokens"))


_MARKERS = "acha|aya|bohat|gaya|gayi|hai|hain|ho|kar|kiya|kya|lagta|lekin|liye|mein|mera|nahi|raha|rahi|se|wala|waly|yeh|yahan"


@query(f"""SELECT CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])({_MARKERS})(?:[^A-Za-z]|$)') THEN 'roman_urdu' ELSE 'english' END AS language, count(*) AS n FROM documents GROUP BY 1""")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS ord FROM documents GROUP BY 1")
def dedupe_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(X.text_hash(F.col("text")).alias("text_hash"), F.col("doc_id").alias("ord"))
    return CL.first_wins(rows, "text_hash")


@query(
    """WITH RECURSIVE r AS (SELECT doc_id, source || ':' || CAST(n_chars % 7 AS VARCHAR) AS i, sha256(text) AS c, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
t AS (SELECT 0::BIGINT AS k, 0::BIGINT AS ord, '' AS verdict, []::VARCHAR[] AS ids, []::VARCHAR[] AS texts
  UNION ALL SELECT r.k, r.doc_id, CASE WHEN list_contains(ids, i) THEN 'duplicate_id' WHEN list_contains(texts, c) THEN 'duplicate_text' ELSE 'kept' END,
    CASE WHEN list_contains(ids, i) OR list_contains(texts, c) THEN ids ELSE list_append(ids, i) END, CASE WHEN list_contains(ids, i) OR list_contains(texts, c) THEN texts ELSE list_append(texts, c) END FROM t JOIN r ON r.k = t.k + 1)
SELECT ord, verdict FROM t WHERE k > 0"""
)
def dedupe_two_key(spark, sf_dir):
    """Rows in order against two keys."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat("source", F.lit(":"), (F.col("n_chars") % 7).cast("string")).alias("identity"), X.text_hash(F.col("text")).alias("content"))
    return CL.two_key_dedup(rows, "identity", "content").select("ord", "verdict")


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<EMAIL>', 'g') AS text, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails FROM documents")
def redact_email(spark, sf_dir):
    out = pii.scrub(table(spark, sf_dir, "documents"), "text", classes=("email",))
    return out.select("doc_id", F.col("text_scrubbed").alias("text"), F.coalesce(F.try_element_at("pii_counts", F.lit("email")), F.lit(0)).cast("long").alias("emails"))


@query()
def redact_pii(spark, sf_dir):
    """All classes, by spans with look-around, which the SQL engine's patterns lack; tests hold exact strings."""
    return pii.scrub(table(spark, sf_dir, "documents"), "text").select("doc_id", "text_scrubbed", F.to_json("pii_counts").alias("counts"))


@query()
def pii_totals(spark, sf_dir):
    return pii.totals(pii.scrub(table(spark, sf_dir, "documents"), "text"))


@query(
    """SELECT c_custkey, coalesce(n_name, '') AS product_id, coalesce(r_name, 'Unknown') AS brand_group
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def registry_join(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    listings = dim.select(F.lit("shop").alias("platform"), F.col("n_nationkey").cast("string").alias("platform_app_id"), F.col("n_name").alias("product_id"), F.col("r_name").alias("brand_group"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("shop").alias("platform"), F.col("c_nationkey").cast("string").alias("platform_app_id"), F.lit(None).cast("string").alias("product_id"))
    return CL.attach_brand(CL.remap_products(rows, listings), listings).select("c_custkey", "product_id", "brand_group")


_STARS = ", ".join(f"count(*) FILTER (WHERE CAST(floor(value) AS BIGINT) % 5 = {k - 1}) AS rating_{k}" for k in range(1, 6))


@query(
    f"""WITH e AS (SELECT *, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'خراب ہے' WHEN 2 THEN 'app خراب' ELSE '  ' END AS t FROM events)
SELECT event_type, count(*) AS records, count(*) - count(DISTINCT user_id) AS duplicates, count(*) FILTER (WHERE trim(coalesce(t, '')) = '') AS empty_texts, {_STARS},
strftime(min(ts), '%Y-%m-%d') AS earliest, strftime(max(ts), '%Y-%m-%d') AS latest, count(*) FILTER (WHERE event_id % 4 = 0 AND coalesce(props, '') <> '') AS script_latin,
count(*) FILTER (WHERE event_id % 4 = 1) AS script_urdu_script, count(*) FILTER (WHERE event_id % 4 = 2) AS script_mixed, count(*) FILTER (WHERE trim(coalesce(t, '')) = '') AS script_empty FROM e GROUP BY 1"""
)
def raw_validation(spark, sf_dir):
    text = F.element_at(F.array(F.col("props"), F.lit("خراب ہے"), F.lit("app خراب"), F.lit("  ")), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        "event_type", F.col("user_id").cast("string").alias("review_id"), text.alias("text"), (F.floor("value") % 5 + 1).cast("int").alias("rating"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp")
    )
    return CL.validate_raw(rows, ("event_type",))


@query(
    f"""WITH {REVIEWS} SELECT language, platform, product AS product_id, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM reviews GROUP BY GROUPING SETS ((language), (platform), (product), ())"""
)
def grouping_report(spark, sf_dir):
    rows = reviews(spark, sf_dir).withColumnsRenamed({"product": "product_id", "date": "timestamp"})
    return CL.report(rows)


_CENSUS_STARS = ", ".join(f"count(*) FILTER (WHERE c_custkey % 5 = {k - 1}) AS rating_{k}" for k in range(1, 6))
_CENSUS_DAY = "'2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')"


@query(
    f"""WITH s AS (SELECT c_nationkey, count(*) AS observed, min({_CENSUS_DAY}) AS earliest, max({_CENSUS_DAY}) AS latest, {_CENSUS_STARS} FROM customer GROUP BY 1)
SELECT n_name, coalesce(observed, 0) AS observed, earliest, latest, {", ".join(f"coalesce(rating_{k}, 0) AS rating_{k}" for k in range(1, 6))}, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey END AS reported FROM nation LEFT JOIN s ON n_nationkey = c_nationkey"""
)
def census(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    listings = n.select("n_name", F.lit("shop").alias("platform"), F.col("n_nationkey").cast("string").alias("platform_app_id"))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "customer").select(F.lit("shop").alias("platform"), F.col("c_nationkey").cast("string").alias("platform_app_id"), (F.col("c_custkey") % 5 + 1).cast("int").alias("rating"), day.alias("timestamp"))
    metadata = n.where("n_nationkey % 3 = 0").select(F.lit("shop").alias("platform"), F.col("n_nationkey").cast("string").alias("platform_app_id"), F.col("n_regionkey").alias("reported"))
    out = CL.census(listings, rows, metadata).drop("platform", "platform_app_id")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("earliest", "latest")})


# ---- labels and ranking

_SIGNAL_SQL = """WITH s AS (
  SELECT 'articles' AS intent, doc_id, CAST(regexp_matches(text, '(?i)\\bthe\\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\\ba\\b') AS INTEGER) AS hits FROM documents
  UNION ALL SELECT 'secrets', doc_id, CAST(regexp_matches(text, '(?i)\\btoken\\b') AS INTEGER) + CAST(regexp_matches(text, '(?i)\\b[0-9a-f]{40}\\b') AS INTEGER) FROM documents
  UNION ALL SELECT 'licence', doc_id, CAST(regexp_matches(text, '(?i)licen[sc]ed?') AS INTEGER) + CAST(regexp_matches(text, '(?i)public') AS INTEGER) FROM documents),
free AS (SELECT * FROM s WHERE hits > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY intent ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM free)"""


def _candidates(spark, sf_dir, top, skip):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text", F.col("doc_id").alias("ord"))
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"))
    scores = {k: X.signal_score(F.col("text"), v) for k, v in SIGNALS.items()}
    return labels.rank_candidates(rows, scores, top, skip, judged)


@query(_SIGNAL_SQL + " SELECT intent, rank, doc_id AS review_id, hits FROM r WHERE rank <= 50")
def signal_rank(spark, sf_dir):
    return _candidates(spark, sf_dir, 50, 0)


@query(
    _SIGNAL_SQL.partition(",\nfree AS")[0]
    + f""", w AS (SELECT s.* FROM s JOIN documents USING (doc_id) WHERE hits > 0 AND {WORDS.format("text")} >= 3),
a AS (SELECT *, CAST(row_number() OVER (PARTITION BY intent ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY rank) AS k FROM a WHERE rank > 50 AND doc_id NOT IN (SELECT doc_id FROM labels)) SELECT intent, rank, doc_id AS review_id, hits FROM f WHERE k <= 25"""
)
def signal_next_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text", F.col("doc_id").alias("ord"))
    seen = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"))
    return studies.next_slice(rows, {k: X.signal_score(F.col("text"), v) for k, v in SIGNALS.items()}, 25, seen)


@query(
    """WITH own AS (SELECT event_type AS hunted_for, CASE WHEN user_id % 4 = 0 THEN event_type ELSE 'other_' || CAST(user_id % 7 AS VARCHAR) END AS label FROM events),
o AS (SELECT hunted_for AS h, label, count(*) AS n FROM own WHERE label <> hunted_for GROUP BY 1, 2), t AS (SELECT h, string_agg(label || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, label) AS confusions FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, label) AS k FROM o) WHERE k <= 3 GROUP BY 1)
SELECT hunted_for, any_value(confusions) AS confusions, count(*) AS candidates, count(*) FILTER (WHERE label = hunted_for) AS hits, round_even(100.0 * count(*) FILTER (WHERE label = hunted_for) / count(*), 1) AS yield,
CASE WHEN count(*) FILTER (WHERE label = hunted_for) = 0 THEN 'absent' WHEN count(*) FILTER (WHERE label = hunted_for) < 5 THEN 'rare' ELSE 'present' END AS verdict FROM own LEFT JOIN t ON h = hunted_for GROUP BY 1"""
)
def hunt_yield(spark, sf_dir):
    label = F.when(F.col("user_id") % 4 == 0, F.col("event_type")).otherwise(F.concat(F.lit("other_"), (F.col("user_id") % 7).cast("string")))
    out = scoring.hunt_yield(table(spark, sf_dir, "events").select(F.col("event_type").alias("hunted_for"), label.alias("label")))
    return out.withColumn("confusions", F.array_join(F.transform("confusions", lambda e: F.concat(e["label"], F.lit("="), e["n"].cast("string"))), ","))


@query(
    """WITH d AS (SELECT doc_id, sha256('model-a|prompt_v2|taxonomy_v3|' || text) AS key FROM documents),
c AS (SELECT sha256('model-a|prompt_v2|taxonomy_v3|' || text) AS key FROM documents WHERE source = 'src0' UNION SELECT sha256('model-a|prompt_v2|taxonomy_v3|' || text) FROM benchmark)
SELECT doc_id, key FROM d WHERE key NOT IN (SELECT key FROM c)"""
)
def cache_misses(spark, sf_dir):
    key = X.cache_key("model-a", "prompt_v2", 3, F.col("text")).alias("key")
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("source = 'src0'").select(key).unionByName(table(spark, sf_dir, "benchmark").select(key))
    return labels.cache_lookup(docs.select("doc_id", key), cache)[1]


@query("SELECT intent, count(*) AS n FROM (SELECT 'q' || CAST(quality AS VARCHAR) AS intent FROM labels UNION ALL SELECT 'toxic' FROM labels WHERE toxic = 1) GROUP BY 1")
def secondary_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("intent"), F.when(F.col("toxic") == 1, "toxic").alias("intent_secondary"))
    return labels.secondary_totals(rows)


@query(
    """SELECT grp, model, count(*) AS n FROM (SELECT doc_id, 'low' AS grp FROM documents WHERE source IN ('src0', 'src1', 'src2') UNION ALL SELECT doc_id, 'even' FROM documents WHERE source IN ('src0', 'src2', 'src4')), (SELECT 'a' AS model UNION ALL SELECT 'b') GROUP BY 1, 2"""
)
def group_jobs(spark, sf_dir):
    rows = labels.in_groups(table(spark, sf_dir, "documents").select("doc_id", "source"), {"low": ["src0", "src1", "src2"], "even": ["src0", "src2", "src4"]}, "source")
    return labels.job_list(rows, ["a", "b"]).groupBy("grp", "model").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT n_regionkey) AS products, count(*) AS listings, count(DISTINCT n_regionkey) FILTER (WHERE n_regionkey < 2) AS core_products, count(*) FILTER (WHERE n_nationkey % 4 <> 0) AS pending, CAST(sum(n_nationkey) AS BIGINT) AS observed FROM nation")
def header_totals(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return CL.header_totals(n.select(F.col("n_regionkey").cast("string").alias("product_id"), F.when(F.col("n_regionkey") < 2, "core").otherwise("extended").alias("inclusion_tier"), (F.col("n_nationkey") % 4 == 0).alias("confirmed"), F.col("n_nationkey").alias("observed")))


# ---- judging and scoring: labels' quality is the truth; two models see toxic and the document's number

_A = "CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(CASE WHEN toxic = 1 THEN 0 ELSE quality END AS VARCHAR) END"
_B = "CAST(CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS VARCHAR)"
_PAIRS = f"""p AS (SELECT l.doc_id, CAST(quality AS VARCHAR) AS truth, {_A} AS a, {_B} AS b, lang, source FROM labels l JOIN documents USING (doc_id) WHERE l.doc_id % 11 <> 0 AND l.doc_id % 13 <> 0)"""


def items(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    a = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).cast("string"))
    b = F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("string")
    return d.select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("meta"), F.create_map(F.lit("a"), a, F.lit("b"), b).alias("predictions"))


def judged(spark, sf_dir):
    """Every 11th was skipped and every 13th not blind; versions alternate."""
    d = table(spark, sf_dir, "labels")
    return d.select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").cast("string").alias("label"), (F.col("doc_id") % 11 == 0).alias("skipped"), (F.col("doc_id") % 13 != 0).alias("blind"), (F.col("doc_id") % 3).cast("int").alias("label_version"), F.col("doc_id").alias("ord"))


def pairs(spark, sf_dir):
    return scoring.eligible(items(spark, sf_dir), judged(spark, sf_dir))


_HASH = "sha256('{seed}:' || {key})"
_DOC_ITEMS = f"i AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents), j AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, CAST(doc_id % 3 AS INTEGER) AS label_version FROM labels)"


def _doc_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    answer = (F.col("doc_id") % 3).cast("string")
    return d.select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("a"), answer, F.lit("b"), F.when(F.col("doc_id") % 4 == 0, answer).otherwise("x")).alias("predictions"))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.select("id")


@query(f"WITH {_DOC_ITEMS} SELECT id FROM i WHERE id NOT IN (SELECT item_id FROM j) ORDER BY {_HASH.format(seed=0, key='id')} LIMIT 100")
def worklist_all(spark, sf_dir):
    return _ordered(worklists.worklist(_doc_items(spark, sf_dir), judged(spark, sf_dir), "all", 100))


@query(f"WITH {_DOC_ITEMS} SELECT id FROM i WHERE CAST(id AS BIGINT) % 4 = 0 AND id NOT IN (SELECT item_id FROM j)")
def worklist_controls(spark, sf_dir):
    return _ordered(worklists.worklist(_doc_items(spark, sf_dir), judged(spark, sf_dir), "controls"))


@query(f"WITH {_DOC_ITEMS} SELECT id FROM i WHERE id IN (SELECT item_id FROM j)")
def worklist_recheck(spark, sf_dir):
    return _ordered(worklists.worklist(_doc_items(spark, sf_dir), judged(spark, sf_dir), "recheck"))


@query(f"WITH {_DOC_ITEMS} SELECT id FROM i JOIN j ON id = item_id WHERE label_version < 2")
def worklist_revisit(spark, sf_dir):
    return _ordered(worklists.worklist(_doc_items(spark, sf_dir), judged(spark, sf_dir), "revisit", label_version=2))


@query(
    f"""WITH {_DOC_ITEMS}, x AS (SELECT i.*, item_id, label_version FROM i LEFT JOIN j ON id = item_id)
SELECT count(*) FILTER (WHERE item_id IS NULL) AS "all", count(*) FILTER (WHERE item_id IS NULL AND CAST(id AS BIGINT) % 4 = 0) AS controls, count(item_id) AS recheck, count(*) FILTER (WHERE label_version < 2) AS revisit FROM x"""
)
def pass_counts(spark, sf_dir):
    return worklists.counts(_doc_items(spark, sf_dir), judged(spark, sf_dir), 2)


@query(f"WITH {_DOC_ITEMS} SELECT count(*) FILTER (WHERE label_version >= 1) AS done, count(*) AS total FROM i JOIN j ON id = item_id")
def pass_progress(spark, sf_dir):
    j = judged(spark, sf_dir)
    return worklists.progress(worklists.worklist(_doc_items(spark, sf_dir), j, "recheck"), j, "revisit", 1)


_ALOW, _AHIGH = sql_wilson("hits", "answered")
_ANSWERS = "x AS (SELECT 'a' AS model, a AS answer, truth, lang, source FROM p UNION ALL SELECT 'b', b, truth, lang, source FROM p)"


@query(f"""WITH {_PAIRS}, {_ANSWERS}, g AS (SELECT model, CAST(sum(CASE WHEN answer = truth THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS answered FROM x WHERE answer <> '' GROUP BY 1)
SELECT *, {sql_pct("hits", "answered")} AS rate, {_ALOW} AS low, {_AHIGH} AS high FROM g""")
def accuracy(spark, sf_dir):
    return scoring.accuracy(pairs(spark, sf_dir))


@query(f"""WITH {_PAIRS}, {_ANSWERS}, g AS (SELECT model, lang AS "group", CAST(sum(CASE WHEN answer = truth THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS answered FROM x WHERE answer <> '' GROUP BY 1, 2)
SELECT *, {sql_pct("hits", "answered")} AS rate, {_ALOW} AS low, {_AHIGH} AS high FROM g""")
def accuracy_by_group(spark, sf_dir):
    return scoring.accuracy_by(pairs(spark, sf_dir), "lang")


_JLOW, _JHIGH = sql_wilson("wrong", "controls")


@query(f"""WITH {_PAIRS}, g AS (SELECT CAST(sum(CASE WHEN a <> truth THEN 1 ELSE 0 END) AS BIGINT) AS wrong, count(*) AS controls FROM p WHERE a <> '' AND a = b)
SELECT *, {sql_pct("wrong", "controls")} AS rate, {_JLOW} AS low, {_JHIGH} AS high FROM g""")
def joint_error(spark, sf_dir):
    return scoring.joint_error(pairs(spark, sf_dir))


@query(f"""WITH {_PAIRS}, {_ANSWERS.replace("truth, lang, source FROM p UNION", "truth, a <> '' AND a = b AS agree FROM p UNION").replace("b, truth, lang, source FROM p)", "b, truth, a <> '' AND a = b FROM p)")}
SELECT model, round(0.8 * sum(CASE WHEN agree AND answer = truth THEN 1 ELSE 0 END) / count(*) FILTER (WHERE agree) + 0.2 * sum(CASE WHEN NOT agree AND answer = truth THEN 1 ELSE 0 END) / count(*) FILTER (WHERE NOT agree), 9) AS accuracy FROM x GROUP BY 1""")
def reweighted(spark, sf_dir):
    return scoring.reweighted_accuracy(pairs(spark, sf_dir), 0.8).withColumn("accuracy", F.round("accuracy", 9))


_KAPPA = """c AS (SELECT count(*) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM p),
e AS (SELECT sum(x.k * y.k) AS chance FROM (SELECT a AS l, count(*) AS k FROM p GROUP BY 1) x JOIN (SELECT b AS l, count(*) AS k FROM p GROUP BY 1) y USING (l))
SELECT n, agree, round((CAST(agree AS DOUBLE) / n - CAST(chance AS DOUBLE) / (n * n)) / (1 - CAST(chance AS DOUBLE) / (n * n)), 9) AS kappa FROM c, e"""


@query(f"WITH p AS (SELECT CAST(quality AS VARCHAR) AS a, CAST(toxic AS VARCHAR) AS b FROM labels), {_KAPPA}")
def kappa(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"))
    return S.kappa(rows, "a", "b").withColumn("kappa", F.round("kappa", 9))


@query(f"WITH q AS (WITH {_PAIRS} SELECT a, b FROM p WHERE a <> ''), p AS (SELECT * FROM q), {_KAPPA}")
def model_agreement(spark, sf_dir):
    return scoring.first_two_agreement(pairs(spark, sf_dir)).withColumn("kappa", F.round("kappa", 9))


_MDE = f"{S.Z + S.Z_BETA!r} * sqrt(2 * base * (1 - base) / smallest)"


@query(f"""WITH {_PAIRS}, g AS (SELECT source, count(*) AS n, sum(CASE WHEN b = truth THEN 1 ELSE 0 END) AS hits FROM p GROUP BY 1),
s AS (SELECT max(CAST(hits AS DOUBLE) / n) - min(CAST(hits AS DOUBLE) / n) AS spread, CAST(sum(hits) AS DOUBLE) / sum(n) AS base, min(n) AS smallest FROM g)
SELECT round(spread, 9) AS spread, round(base, 9) AS baseline, smallest, round({_MDE}, 9) AS detectable, CAST(ceil(2 * base * (1 - base) * power({S.Z + S.Z_BETA!r} / 0.1, 2)) AS BIGINT) AS needed FROM s""")
def spread_power(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.col("meta")["source"].alias("g"), (F.col("predictions")["b"] == F.col("truth")).alias("hit"))
    facts = S.spread(S.group_rates(rows, "g", "hit")).withColumn("base", F.col("hits") / F.col("n"))
    return facts.select(F.round("spread", 9).alias("spread"), F.round("base", 9).alias("baseline"), "smallest", F.round(S.minimum_detectable_effect(F.col("base"), F.col("smallest")), 9).alias("detectable"), S.required_n(F.col("base"), F.lit(0.1)).alias("needed"))


@query()
def permutation(spark, sf_dir):
    """A random test: its p is held against label shuffling in the tests."""
    rows = pairs(spark, sf_dir).select(F.col("meta")["lang"].alias("g"), (F.col("predictions")["b"] == F.col("truth")).alias("hit"))
    return S.permutation_test(rows, "g", "hit", 20_000, 7)


@query(f"""WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality <> 0) AS fp, count(*) FILTER (WHERE toxic <> 1 AND quality = 0) AS fn, count(*) FILTER (WHERE toxic <> 1 AND quality <> 0) AS tn FROM labels)
SELECT *, {sql_pct("tp", "(tp + fp)")} AS precision, {sql_pct("tp", "(tp + fn)")} AS recall FROM c""")
def confusion_pr(spark, sf_dir):
    return scoring.confusion(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query(f"""WITH {_PAIRS} SELECT CASE WHEN truth IN ('none') THEN 'coverage_gap' WHEN a = truth THEN 'a_right' WHEN b = truth THEN 'b_right' ELSE 'neither' END AS kind, count(*) AS n FROM p WHERE a <> b GROUP BY 1""")
def decompose(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("truth", F.col("predictions")["a"].alias("a"), F.col("predictions")["b"].alias("b"))
    return scoring.decompose(rows)


@query("""WITH t AS (SELECT conv_id, turn, role || CAST(length(text) % 3 AS VARCHAR) AS label FROM conversations), p AS (SELECT x.label AS a, y.label AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.turn = 0 AND y.turn = 1)
SELECT least(a, b) AS x, greatest(a, b) AS y, count(*) AS n FROM p WHERE a <> b GROUP BY 1, 2 HAVING count(*) > 1""")
def retest_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("label", F.concat("role", (F.length("text") % 3).cast("string")))
    both = scoring.retest(rows.where("turn = 0"), rows.where("turn = 1"), "conv_id")
    return scoring.confused_pairs(both)


@query(f"""WITH {_PAIRS}, g AS (SELECT lang, CAST(sum(CASE WHEN b = truth THEN 1 ELSE 0 END) AS BIGINT) AS c, count(*) AS n FROM p WHERE doc_id % 17 <> 0 GROUP BY 1),
w AS (SELECT max(CASE WHEN lang = 'en' THEN {sql_pct("c", "n")} END) AS en, max(CASE WHEN lang = 'fr' THEN {sql_pct("c", "n")} END) AS fr, max(CASE WHEN lang = 'de' THEN {sql_pct("c", "n")} END) AS de FROM g)
SELECT 'b' AS model, en, fr, de, round_even(en - fr, 1) AS en_gap, round_even(de - fr, 1) AS de_gap FROM w""")
def gap_pivot(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.lit("b").alias("model"), F.col("meta")["lang"].alias("language"), (F.col("predictions")["b"] == F.col("truth")).alias("correct"), F.when(F.col("id").cast("long") % 17 == 0, "error").otherwise("ok").alias("status"))
    return scoring.pilot_gaps(scoring.pilot_score(rows), ["en", "fr", "de"], "fr")


@query(f"""WITH c AS (SELECT event_type AS label, count(*) FILTER (WHERE user_id % 2 = 0) AS x, count(*) FILTER (WHERE user_id % 2 = 1) AS y FROM events GROUP BY 1),
s AS (SELECT label, x + y AS n, {sql_pct("x", "sum(x) OVER ()")} AS share_a, {sql_pct("y", "sum(y) OVER ()")} AS share_b FROM c)
SELECT label, n, share_a, share_b, round_even(share_a - share_b, 1) AS gap, abs(round_even(share_a - share_b, 1)) > 3 AS marked FROM s ORDER BY n DESC, label LIMIT 12""")
def complaint_mix(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("side"))
    return scoring.complaint_mix(rows, "side", "event_type", ("even", "odd"))


# ---- samples


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def sample_even(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))
    return sampling.first_per_slice(rows, ["source", "lang"], 3).select("doc_id", "source", "lang")


@query(f"""WITH r AS (SELECT doc_id, source, lang, doc_id % 5 AS rating FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY source, lang, rating ORDER BY {_HASH.format(seed=SEED, key="CAST(doc_id AS VARCHAR)")}, doc_id) AS turn FROM r)
SELECT doc_id FROM t ORDER BY turn, source, lang, rating LIMIT 150""")
def sample_round_robin(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("rating", F.col("doc_id") % 5)
    return sampling.round_robin(rows, ["source", "lang", "rating"], 150, SEED, "doc_id").select("doc_id")


@query(f"""WITH r AS (SELECT doc_id, lang, n_chars % 3 = 0 AS flag FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY lang, flag ORDER BY {_HASH.format(seed=5, key="CAST(doc_id AS VARCHAR)")}, doc_id) AS n, least(count(*) FILTER (WHERE flag) OVER (PARTITION BY lang), 12) AS have FROM r)
SELECT doc_id, lang FROM k WHERE n <= CASE WHEN flag THEN have ELSE 25 - have END""")
def sample_quota(spark, sf_dir):
    return sampling.quota_sample(table(spark, sf_dir, "documents"), "lang", F.col("n_chars") % 3 == 0, 25, 12, 5, "doc_id").select("doc_id", "lang")


_BUCKET = f"CASE WHEN w < 10 THEN 'short' WHEN w < 20 THEN 'medium' WHEN w < 40 THEN 'long' ELSE 'very_long' END"


@query(f"""WITH r AS (SELECT doc_id, lang, {WORDS.format("text")} AS w FROM documents), b AS (SELECT doc_id, lang, {_BUCKET} AS bucket FROM r),
s AS (SELECT bucket, CAST(round_even(30 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT) AS want FROM b WHERE lang = 'es' GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY {_HASH.format(seed=3, key="CAST(doc_id AS VARCHAR)")}, doc_id) AS n FROM b)
SELECT doc_id, lang, bucket FROM k JOIN s USING (bucket) WHERE n <= want""")
def sample_length_matched(spark, sf_dir):
    return sampling.length_matched(table(spark, sf_dir, "documents"), "lang", "es", 30, 3, "doc_id").select("doc_id", "lang", "bucket")


@query(f"""WITH r AS (SELECT doc_id, lang, CASE WHEN contains(text, '@') THEN 0 WHEN regexp_matches(text, '[0-9]{{5}}') THEN 1 ELSE 2 END AS priority FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY priority, {_HASH.format(seed=9, key="CAST(doc_id AS VARCHAR)")}, doc_id) AS n FROM r)
SELECT doc_id, lang, priority FROM k WHERE n <= CASE lang WHEN 'en' THEN 16 WHEN 'fr' THEN 16 WHEN 'de' THEN 15 WHEN 'es' THEN 15 ELSE 0 END""")
def sample_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    out = sampling.audit_sample(rows, 62, 9, ("en", "fr", "de", "es"), "doc_id", "lang", F.contains("text", F.lit("@")), F.col("text").rlike("[0-9]{5}"))
    return out.select("doc_id", "lang", "priority")


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_HASH.format(seed=4, key='CAST(doc_id AS VARCHAR)')}, doc_id) AS k FROM documents) WHERE k <= 10")
def sample_per_group(spark, sf_dir):
    return sampling.random_per_group(table(spark, sf_dir, "documents"), "source", 10, 4, "doc_id").select("doc_id", "source")


# ---- sources, sets and increments


@query("SELECT conv_id, turn, text, first_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, min(turn) OVER (PARTITION BY conv_id) AS first_turn FROM conversations) WHERE k = 1")
def latest_wins(spark, sf_dir):
    return CL.last_wins(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "text", F.col("first_ord").alias("first_turn"))


@query("""WITH k AS (SELECT event_type, event_id, event_id // 200 AS page, CASE WHEN user_id % 9 <> 0 THEN 1 ELSE 0 END AS known FROM events),
r AS (SELECT *, sum(1 - known) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM k), l AS (SELECT *, sum(known) OVER (PARTITION BY event_type, run ORDER BY event_id) AS length FROM r),
e AS (SELECT event_type, page, CAST(arg_max(length, event_id) AS BIGINT) AS last_run FROM l GROUP BY 1, 2) SELECT *, last_run >= 10 AS stops FROM e""")
def caught_up_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 200))
    return refresh.caught_up(rows, "event_type", "page", "event_id", F.col("user_id") % 9 != 0, 10)


@query("""SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'known', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark)""")
def id_set_ops(spark, sf_dir):
    d, own, b = (table(spark, sf_dir, t).select(F.col(c).alias("doc_id")) for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("benchmark", "item_id")))
    kinds = (("both", d.intersect(own)), ("unlabelled", d.subtract(own)), ("known", refresh.known_ids(d, own, b, key=("doc_id",))))
    out = None
    for kind, ids in kinds:
        one = ids.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS text, props->>'$.k' AS k, CASE WHEN event_id % 2 = 0 THEN event_type ELSE NULL END AS prediction FROM events""")
def props_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    models = F.concat(F.lit('{"m": '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"intent": "'), "event_type", F.lit('"}'))).otherwise('""'), F.lit("}"))
    line = F.concat(F.lit('{"review_id": "'), F.col("event_id").cast("string"), F.lit('", "text_clean": "'), "event_type", F.lit('", "meta": '), "props", F.lit(', "models": '), models, F.lit("}"))
    out = R.items(e.select(line.alias("value")))
    return out.select("id", "text", F.col("meta")["k"].alias("k"), F.try_element_at("predictions", F.lit("m")).alias("prediction"))


@query("SELECT intent, count(*) AS n FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN NULL ELSE 'view' END AS intent FROM events) GROUP BY 1")
def reply_intents(spark, sf_dir):
    replies = F.element_at(F.array(F.lit(' "click". '), F.lit("The answer is: ERROR"), F.lit("click or error"), F.lit("`view`")), (F.col("user_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(parsing.intent_reply(replies, ["click", "error", "view"]).alias("intent"))
    return rows.groupBy("intent").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(sum((user_id * 3.0 + event_id % 100 * 15.0) / 1000000), 6) AS usd FROM events GROUP BY 1")
def spend_by_type(spark, sf_dir):
    usd = parsing.spend_usd(F.col("user_id"), F.col("event_id") % 100, F.lit(3.0), F.lit(15.0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(usd), 6).alias("usd"))


@query()
def title_match(spark, sf_dir):
    """The most similar of all suppliers' titles for each part: the similarity is no SQL function; tests hold exact ratios."""
    targets = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))
    titles = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.col("s_suppkey").alias("ord"))
    return similar.most_similar_titles(targets, titles).withColumn("ratio", F.round("ratio", 6))


from tallybrook.plans import more, runs  # noqa: E402, F401  (register the queries of studies and of runs)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
