"""Queries of labelling runs, upserts, known ids, file digests, quarantine and the SQL views, with equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallybrook import schemas
from tallybrook.operators import facets
from tallybrook.operators import label_run as L
from tallybrook.plans import registry as G
from tallybrook.plans import views
from tallybrook.plans.registry import HIGH, LOW, query, sql_pct, table
from tallybrook.sources import files, paged, quarantine
from tallybrook.sources.bucketed import Bucketed
from tallybrook.sources.shared import shared_dir
from tallybrook.streaming.known import KnownIds


def _folder(spark, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


# ---- labelling


def _by_length(intent: str):
    """A model that tells an intent, and the text's length as its input tokens."""

    def make():
        def ask(text: str):
            if "token" in text:
                return None, len(text), 0
            label = {"intent": intent, "refund_requested": False, "language": "other", "severity": "friction", "confidence": 0.5, "rationale": intent}
            return label, len(text), 7

        return ask

    return make


@query("""WITH f AS (SELECT DISTINCT text FROM documents WHERE source = 'src0' AND NOT contains(text, 'token')), a AS (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM f))
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN text IN (SELECT text FROM f) THEN 'first' WHEN NOT contains(text, 'token') THEN 'second' END AS label_intent,
  (SELECT count(*) FROM a) AS live_calls, (SELECT count(*) FROM documents) - (SELECT count(*) FROM a) AS cache_hits, (SELECT CAST(sum(length(text)) AS BIGINT) FROM a) AS input_tokens FROM documents""")
def label_run(spark, sf_dir):
    """Two runs over one cache: the second asks each text once that the first has no answer for."""
    cache = _folder(spark, "labels")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("text").alias("text_scrubbed"))
    L.label_run(docs.where("source = 'src0'"), L.RowPredictor(_by_length("first")), cache, "model-a", "prompt_v2", 3)
    out, spend = L.label_run(docs, L.RowPredictor(_by_length("second")), cache, "model-a", "prompt_v2", 3)
    return out.select("id", "label_intent", *[F.lit(spend[c]).cast("long").alias(c) for c in ("live_calls", "cache_hits", "input_tokens")])


# ---- upserts and known ids


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN 'changed' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 100 = 8")
def bucket_upsert(spark, sf_dir):
    """All orders in a bucketed table; then a hundredth of them changes, and as many are new."""
    schema = schemas.of("o_orderkey LONG, status STRING, ord LONG")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("long").alias("ord"))
    held = Bucketed(spark, _folder(spark, "orders"), schema, ("o_orderkey",))
    held.upsert(o, 0)
    changed = o.where("o_orderkey % 100 = 7").withColumn("status", F.lit("changed"))
    held.upsert(changed.unionByName(o.where("o_orderkey % 100 = 8").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("new").alias("status"), "ord")), 1)
    return held.read().select("o_orderkey", "status")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def unseen_ids(spark, sf_dir):
    """Lines whose order is not among the finished ones, by a filter of these and an exact anti-join for the rest."""
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return KnownIds(known, ("l_orderkey",)).unseen(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


# ---- files and lines


@query("""WITH e AS (SELECT event_type, event_id // 500 + 1 AS page, '{"review_id":"' || event_id || '","user_id":' || user_id || '}' || chr(10) AS line, event_id FROM events)
SELECT event_type, 'page_' || lpad(CAST(page AS VARCHAR), 6, '0') || '.jsonl' AS name, CAST(sum(length(line)) AS BIGINT) AS length, sha256(string_agg(line, '' ORDER BY event_id)) AS sha256 FROM e GROUP BY event_type, page""")
def file_digests(spark, sf_dir):
    """Digests of the files of landed pages."""
    root = _folder(spark, "landed")
    e = table(spark, sf_dir, "events")
    review = F.to_json(F.struct(F.col("event_id").cast("string").alias("review_id"), "user_id"))
    paged.land_pages(e.select(F.col("event_type").alias("app_id"), (F.floor(F.col("event_id") / 500) + 1).alias("page"), F.col("event_id").alias("place"), review.alias("review"), F.lit(False).alias("more")), root)
    found = files.file_digests(spark, root, "page_*.jsonl")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("event_type"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")


@query("""SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'no review_id' WHEN 3 THEN 'rating is of another type' END AS reason,
CASE WHEN user_id % 6 > 3 THEN CAST(event_id AS VARCHAR) END AS review_id, CASE user_id % 6 WHEN 4 THEN 5 END AS rating FROM events""")
def judged_lines(spark, sf_dir):
    """Lines of each kind of damage, told apart in one parse."""
    ident = F.col("event_id").cast("string")
    kinds = [
        F.concat(F.lit('{"review_id": "'), ident), F.concat(F.lit("["), ident, F.lit("]")), F.lit('{"review_id": "", "rating": 1}'), F.concat(F.lit('{"review_id": "'), ident, F.lit('", "rating": "five"}')),
        F.concat(F.lit('{"review_id": "'), ident, F.lit('", "rating": 5}')), F.concat(F.lit('{"review_id": "'), ident, F.lit('", "rating": null, "more": [1]}')),
    ]
    lines = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*kinds), (F.col("user_id") % 6 + 1).cast("int")).alias("value"))
    return quarantine.judged_lines(lines, schemas.REVIEW).select("event_id", "reason", "row.review_id", "row.rating")


# ---- SQL text over views and functions


@query(f"""WITH {G.REVIEWS}, f AS (SELECT product, language, version, substr(date, 1, 7) AS month, coalesce(nullif(rating, 0), 5) <= 2 AS is_bad FROM reviews WHERE language = 'en'),
g AS (SELECT CASE WHEN grouping(product) = 0 THEN 'product' WHEN grouping(version) = 0 THEN 'release' ELSE 'month' END AS section, coalesce(product, version, month) AS key,
  count(*) AS total, count(*) FILTER (WHERE is_bad) AS bad FROM f GROUP BY GROUPING SETS ((product), (version), (month)))
SELECT section, key, total, bad, {sql_pct("bad", "total")} AS bad_pct, {LOW} AS low, {HIGH} AS high FROM g""")
def review_report_sql(spark, sf_dir):
    views.register(spark, G.reviews(spark, sf_dir))
    return spark.sql("SELECT * FROM review_report(NULL, 'en') WHERE section IN ('product', 'release', 'month')")


@query(f"""WITH {G._PAIRS}, a AS (SELECT lang, unnest([{{'model': 'a', 'answer': a}}, {{'model': 'b', 'answer': b}}], recursive := true), truth FROM p),
g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'group' ELSE 'model' END AS section, model, lang AS grp, count(*) FILTER (WHERE answer = truth) AS bad, count(*) AS total FROM a WHERE answer IS NOT NULL AND answer <> '' GROUP BY GROUPING SETS ((model), (model, lang)))
SELECT section, model, grp, bad AS hits, total, {sql_pct("bad", "total")} AS rate, {LOW} AS low, {HIGH} AS high FROM g""")
def score_sql(spark, sf_dir):
    views.register(spark, items=G.items(spark, sf_dir), judgements=G.judged(spark, sf_dir))
    return spark.sql("SELECT * FROM score('lang')")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND o_orderkey % 3 <> 1")
def table_filters(spark, sf_dir):
    """Filters of report tables: tier, status and vertical, each with some of its values."""
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("inclusion_tier"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).cast("string").alias("vertical"))
    return facets.select(rows, facets.Filters(more={"inclusion_tier": {"1-URGENT", "2-HIGH"}, "status": {"O"}, "vertical": {"0", "2"}})).select("o_orderkey")
