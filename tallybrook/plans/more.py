"""Queries of studies, sources and text features, with equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybrook.functions import catalogue as K
from tallybrook.functions import stats as S
from tallybrook.functions import text as X
from tallybrook.operators import clean as CL
from tallybrook.operators import sampling, scoring, studies, worklists
from tallybrook.plans import registry as G
from tallybrook.plans.registry import query, sql_pct, sql_wilson, table
from tallybrook.sources import labelling, paged
from tallybrook.sources import reviews as R
from tallybrook.sources.shared import shared_dir
from tallybrook.streaming import refresh
from tallybrook.streaming.walk import walk

LOW, HIGH = sql_wilson("hits", "total", S.Z_SCRIPTS)
BLOW, BHIGH = sql_wilson("hits", "total")
_BAND = f"{sql_pct('hits', 'total')} AS rate, {LOW} AS low, {HIGH} AS high"

# ---- studies: two models' answers to the labelled documents

_A = "CASE WHEN doc_id % 7 = 0 THEN 'unclassifiable' ELSE 'q' || CAST(quality AS VARCHAR) END"
_B = "CASE WHEN doc_id % 5 = 0 THEN 'unclassifiable' ELSE 'q' || CAST(CASE WHEN toxic = 1 THEN 0 ELSE quality END AS VARCHAR) END"
_STUDY = f"""w AS (SELECT doc_id, lang AS language, {_A} AS a, {_B} AS b, CASE WHEN doc_id % 9 = 0 THEN 'unclassifiable' ELSE 'q' || CAST(quality AS VARCHAR) END AS truth,
 CASE WHEN doc_id % 2 = 0 THEN 'praise' END AS reason, toxic = 1 AS two, doc_id % 4 = 0 AS refund, CAST(CASE WHEN doc_id % 6 = 0 THEN 5 ELSE doc_id % 6 END AS INTEGER) AS rating,
 CASE doc_id % 3 WHEN 0 THEN 'financial_loss' WHEN 1 THEN 'friction' ELSE 'informational' END AS severity, doc_id % 2 = 0 AS proxy FROM labels JOIN documents USING (doc_id))"""


def study(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    q = lambda c: F.concat(F.lit("q"), c.cast("string"))
    no = F.lit(studies.NONE)
    severity = F.element_at(F.array(F.lit("financial_loss"), F.lit("friction"), F.lit("informational")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(
        "doc_id", F.col("lang").alias("language"), F.when(F.col("doc_id") % 7 == 0, no).otherwise(q(F.col("quality"))).alias("a"),
        F.when(F.col("doc_id") % 5 == 0, no).otherwise(q(F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")))).alias("b"),
        F.when(F.col("doc_id") % 9 == 0, no).otherwise(q(F.col("quality"))).alias("truth"), F.when(F.col("doc_id") % 2 == 0, "praise").alias("reason"),
        F.when(F.col("toxic") == 1, "toxic").alias("intent_secondary"), (F.col("doc_id") % 4 == 0).alias("refund_requested"), (F.col("doc_id") % 6).cast("int").alias("rating"),
        severity.alias("severity"), (F.col("doc_id") % 2 == 0).alias("severity_proxy"), (F.col("source").isin("src0", "src1", "src2")).alias("side"),
    )


def _sections(*parts: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS section, {k} AS key, CAST({h} AS BIGINT) AS hit FROM w WHERE {c}" for s, k, h, c in parts)


_U = "'unclassifiable'"
_FLAGS = (("unclassifiable_either", f"a = {_U} OR b = {_U}"), ("unclassifiable_both", f"a = {_U} AND b = {_U}"), ("multi_intent", "two"), ("agreement", "a = b"), ("refund", "refund"))
_DIAGNOSTIC = _sections(
    *[(s, k, f"({h})", "true") for s, h in _FLAGS for k in ("language", "NULL")], ("praise", "CAST(rating AS VARCHAR)", f"(b = {_U})", "true"), ("complaint_unclassifiable", "NULL", f"(b = {_U})", "rating <= 2"),
    ("complaint_both", "NULL", f"(a = {_U} AND b = {_U})", "rating <= 2"), ("complaint_agreement", "NULL", "(a = b)", "rating <= 2"), ("severity", "severity", "true", "true"), ("coverage", "b", "true", "true"),
    ("proxy", "CASE WHEN proxy THEN '+' ELSE '-' END || '/' || CASE WHEN severity = 'financial_loss' THEN '+' ELSE '-' END", "(proxy = (severity = 'financial_loss'))", "true"),
    ("proxy_precision", "NULL", "(severity = 'financial_loss')", "proxy"), ("proxy_recall", "NULL", "proxy", "severity = 'financial_loss'"),
)


def _rates(facts: str, shares: str) -> str:
    return f"""WITH {_STUDY}, f AS ({facts}), g AS (SELECT section, key, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n FROM f GROUP BY 1, 2),
t AS (SELECT section, key, hits, CASE WHEN section IN ({shares}) THEN CAST(sum(n) OVER (PARTITION BY section) AS BIGINT) ELSE n END AS total FROM g) SELECT *, {_BAND} FROM t"""


_KAPPA = f"""v AS (SELECT language AS key, false AS whole, a, b FROM w UNION ALL SELECT NULL, true, a, b FROM w), n AS (SELECT whole, key, count(*) FILTER (WHERE a = b) AS hits, count(*) AS total FROM v GROUP BY 1, 2),
x AS (SELECT whole, key, a AS l, count(*) AS k FROM v GROUP BY 1, 2, 3), y AS (SELECT whole, key, b AS l, count(*) AS k FROM v GROUP BY 1, 2, 3),
c AS (SELECT x.whole, x.key, sum(x.k * y.k) AS chance FROM x JOIN y ON x.whole = y.whole AND x.key IS NOT DISTINCT FROM y.key AND x.l = y.l GROUP BY 1, 2),
o AS (SELECT n.key, hits, total, coalesce(chance, 0) / (CAST(total AS DOUBLE) * total) AS e FROM n LEFT JOIN c ON n.whole = c.whole AND n.key IS NOT DISTINCT FROM c.key)
SELECT 'kappa' AS section, key, hits, total, {_BAND}, CASE WHEN e <> 1 THEN round_even((CAST(hits AS DOUBLE) / total - e) / (1 - e), 3) END AS kappa FROM o"""


_PARTS = _rates(_DIAGNOSTIC, "'severity', 'coverage'")


@query(f"""SELECT *, CAST(NULL AS DOUBLE) AS kappa FROM ({_PARTS}) UNION ALL BY NAME SELECT * FROM (WITH {_STUDY}, {_KAPPA})""")
def diagnostic_report(spark, sf_dir):
    return studies.diagnostic_report(study(spark, sf_dir))


@query(f"""WITH {_STUDY} SELECT language, count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, count(*) FILTER (WHERE a = {_U} OR b = {_U}) AS either_none, count(*) FILTER (WHERE a = {_U} AND b = {_U}) AS both_none FROM w GROUP BY ROLLUP (language)""")
def agreement_report(spark, sf_dir):
    return scoring.agreement_report(study(spark, sf_dir), "language")


_KIND = f"CASE WHEN truth = {_U} AND a <> {_U} AND b <> {_U} THEN 'coverage_gap' WHEN a = truth THEN 'a_right' WHEN b = truth THEN 'b_right' ELSE 'neither' END"
_REASON = "coalesce(reason, 'unrecorded')"


@query(
    _rates(
        _sections(
            ("kind", _KIND, "true", "a <> b"), ("gap_reason", _REASON, "true", f"a <> b AND {_KIND} = 'coverage_gap'"), ("bias", "'a'", f"({_KIND} = 'a_right')", f"a <> b AND {_KIND} IN ('a_right', 'b_right')"),
            ("both_wrong", "NULL", "(a <> truth)", "a = b"), ("accuracy", "'a'", "(a = truth)", "true"), ("accuracy", "'b'", "(b = truth)", "true"), ("accuracy", "'both'", "(a = truth AND b = truth)", "true"), ("none_reason", _REASON, "true", f"truth = {_U}"),
        ),
        "'kind', 'gap_reason', 'none_reason'",
    )
)
def disagreement_study(spark, sf_dir):
    return studies.disagreement_study(study(spark, sf_dir))


_RUNS = f"x AS (SELECT doc_id, a, b FROM w WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0), p AS (SELECT count(*) FILTER (WHERE a <> b) AS hits, count(*) AS total FROM x)"


def _population(spark, sf_dir):
    rows = study(spark, sf_dir)
    runs = [rows.select("doc_id", F.when(F.col("doc_id") % n == 0, "error").when(F.col("doc_id") % 2 == 0, "cached").otherwise("ok").alias("status"), F.col(m).alias("label")) for m, n in (("a", 11), ("b", 13))]
    return studies.population_disagreement(*runs, key="doc_id")


@query(f"WITH {_STUDY}, {_RUNS} SELECT *, {sql_pct('hits', 'total')} AS rate FROM p")
def population_disagreement(spark, sf_dir):
    return _population(spark, sf_dir)


@query(f"""WITH {_STUDY}, {_RUNS}, m AS (SELECT 'a' AS model, a <> b AS apart, CAST(a = truth AS INTEGER) AS hit FROM w UNION ALL SELECT 'b', a <> b, CAST(b = truth AS INTEGER) FROM w)
SELECT model, round_even(100 * avg(hit), 1) AS raw, round_even(100 * (any_value(CAST(hits AS DOUBLE) / total) * avg(hit) FILTER (WHERE apart) + (1 - any_value(CAST(hits AS DOUBLE) / total)) * avg(hit) FILTER (WHERE NOT apart)), 1) AS corrected FROM m, p GROUP BY 1""")
def corrected_accuracy(spark, sf_dir):
    return studies.corrected_accuracy(study(spark, sf_dir), _population(spark, sf_dir))


@query(f"""WITH {G._PAIRS}, {G._ANSWERS}, g AS (SELECT model, lang, CAST(sum(CASE WHEN answer = truth THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS r FROM x WHERE answer <> '' GROUP BY 1, 2),
s AS (SELECT model, 100 * (max(r) - min(r)) AS points, first(lang ORDER BY r DESC, lang) AS best, first(lang ORDER BY r, lang) AS worst FROM g GROUP BY 1 HAVING count(*) > 1)
SELECT model, round_even(points, 1) AS spread, best, worst, CASE WHEN points < 20 THEN 'no detectable gap' ELSE 'gap' END AS verdict FROM s""")
def language_result(spark, sf_dir):
    return studies.language_result(G.pairs(spark, sf_dir), "lang")


@query(f"""WITH i AS (SELECT lang AS "group", {G._A} AS a, {G._B} AS b FROM labels JOIN documents USING (doc_id)),
g AS (SELECT "group", count(*) FILTER (WHERE a = '' OR a = b) AS hits, count(*) AS total FROM i GROUP BY 1) SELECT *, {_BAND} FROM g""")
def agreement_by_language(spark, sf_dir):
    return studies.agreement_by(G.items(spark, sf_dir), "lang")


@query("""WITH g AS (SELECT lang, source AS label, count(*) AS n FROM documents GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, label) AS INTEGER) AS rank FROM g) SELECT lang, label, n, rank FROM k WHERE rank <= 3""")
def intent_mix(spark, sf_dir):
    return studies.top_labels(table(spark, sf_dir, "documents"), "lang", "source")


_AUTHORED = " UNION ALL ".join(f"SELECT '{s}' AS section, {k} AS key, CAST({h} AS BIGINT) AS hit FROM w WHERE {c}" for s, k, h, c in (("accuracy", "'a'", "(a = truth)", "true"), ("accuracy", "'b'", "(b = truth)", "doc_id % 10 <> 0"), ("agreement", "language", "(a = b)", "doc_id % 10 <> 0"), ("agreement", "NULL", "(a = b)", "doc_id % 10 <> 0")))


@query(f"""WITH {_STUDY}, f AS ({_AUTHORED}), t AS (SELECT section, key, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS total FROM f GROUP BY 1, 2)
SELECT *, {_BAND}, CASE WHEN section = 'agreement' AND key IS NULL THEN round_even(100.0 * hits / total - 100.0 * 390 / 490, 1) END AS gap FROM t""")
def authored_against_real(spark, sf_dir):
    rows = study(spark, sf_dir).select("language", F.col("truth").alias("gold"), "a", F.when(F.col("doc_id") % 10 != 0, F.col("b")).alias("b"))
    return studies.authored_against_real(rows, 390, 490)


@query(f"""WITH {_STUDY}, v AS (SELECT w.*, source IN ('src0', 'src1', 'src2') AS side FROM w JOIN documents USING (doc_id)), s AS (SELECT side, severity, count(*) AS n FROM v GROUP BY 1, 2)
SELECT side AS "group", 'severity' AS section, severity AS key, n, {sql_pct("n", "sum(n) OVER (PARTITION BY side)")} AS rate FROM s
UNION ALL SELECT side, 'agreement', NULL, count(*) FILTER (WHERE a = b), {sql_pct("count(*) FILTER (WHERE a = b)", "count(*)")} FROM v GROUP BY 1""")
def trust_by_group(spark, sf_dir):
    return studies.trust_by_group(study(spark, sf_dir), "side")


_SCORES = f"""m AS (SELECT 'model' AS section, model, NULL::VARCHAR AS grp, CAST(sum(CASE WHEN answer = truth THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS total, NULL::DOUBLE AS kappa FROM x WHERE answer <> '' GROUP BY 2
  UNION ALL SELECT 'joint', NULL, NULL, CAST(sum(CASE WHEN a <> truth THEN 1 ELSE 0 END) AS BIGINT), count(*), NULL FROM p WHERE a <> '' AND a = b
  UNION ALL SELECT 'agreement', NULL, NULL, agree, n, round_even(kappa, 3) FROM ag
  UNION ALL SELECT 'group', model, lang, CAST(sum(CASE WHEN answer = truth THEN 1 ELSE 0 END) AS BIGINT), count(*), NULL FROM x WHERE answer <> '' GROUP BY 2, 3)"""


@query(f"""WITH {G._PAIRS}, {G._ANSWERS}, ag AS (WITH q AS (SELECT a, b FROM p WHERE a <> ''), {G._KAPPA.replace("FROM p", "FROM q")}), {_SCORES},
c AS (SELECT (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS i, (SELECT count(*) FROM labels) AS j, (SELECT count(*) FROM p) AS s)
SELECT section, model, grp AS "group", hits, total, {sql_pct("hits", "total")} AS rate, {BLOW} AS low, {BHIGH} AS high, kappa FROM m
UNION ALL SELECT k, NULL, NULL, NULL, n, NULL, NULL, NULL, NULL FROM (SELECT 'items' AS k, i AS n FROM c UNION ALL SELECT 'judged', j FROM c UNION ALL SELECT 'scored', s FROM c UNION ALL SELECT 'excluded', j - s FROM c)""")
def score_report(spark, sf_dir):
    return studies.score_report(G.items(spark, sf_dir), G.judged(spark, sf_dir), "lang")


@query(f"""WITH {G._PAIRS}, {G._ANSWERS}, g AS (SELECT model, lang, count(*) AS n, sum(CASE WHEN answer = truth THEN 1 ELSE 0 END) AS h FROM x WHERE answer <> '' GROUP BY 1, 2)
SELECT model, round(max(CAST(h AS DOUBLE) / n) - min(CAST(h AS DOUBLE) / n), 9) AS spread, round(CAST(sum(h) AS DOUBLE) / sum(n), 9) AS baseline, min(n) AS smallest FROM g GROUP BY 1""")
def group_power(spark, sf_dir):
    """The parts of the power report that no random draw decides; tests hold p."""
    out = scoring.power_report(G.pairs(spark, sf_dir), "lang", 2000)
    return out.select("model", F.round("spread", 9).alias("spread"), F.round("baseline", 9).alias("baseline"), "smallest")


@query(f"""WITH {G._PAIRS}, {G._ANSWERS}, g AS (SELECT model, CAST(sum(CASE WHEN answer = truth THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS total FROM x WHERE answer <> '' GROUP BY 1), r AS (SELECT model, {sql_pct("hits", "total")} AS rate, {BLOW} AS low, {BHIGH} AS high FROM g)
SELECT (SELECT first(model ORDER BY rate DESC, model DESC) FROM r) AS best, (SELECT first(model ORDER BY rate, model) FROM r) AS worst, (SELECT first(low ORDER BY rate DESC, model DESC) FROM r) > (SELECT first(high ORDER BY rate, model) FROM r) AS ahead""")
def winner(spark, sf_dir):
    return scoring.winner(scoring.accuracy(G.pairs(spark, sf_dir))).select("best.model", F.col("worst.model").alias("worst"), "ahead").withColumnRenamed("model", "best")


# ---- increments, quotas, sources


#: Walks over the events of a type, newest first: ids that repeat (click, purchase), ids that are mostly known (view), rows without an id, and a type whose 40th page is its last.
_WALKS = """i AS (SELECT event_type, event_id, event_id // 200 AS page, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'click' THEN user_id WHEN event_type = 'purchase' THEN user_id * 10 + event_id % 10 ELSE event_id END AS id FROM events),
j AS (SELECT *, coalesce((id * 7919) % 100 < CASE event_type WHEN 'view' THEN 97 WHEN 'purchase' THEN 30 ELSE 0 END, false) AS known FROM i),
k AS (SELECT *, CAST(NOT known AND row_number() OVER (PARTITION BY event_type, id ORDER BY event_id) = 1 AS INTEGER) AS new FROM j),
r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM k), l AS (SELECT *, sum(1 - new) OVER (PARTITION BY event_type, run ORDER BY event_id) AS length FROM r),
p AS (SELECT event_type, page, arg_max(length, event_id) >= 30 AS stops, sum(new) AS fresh FROM l GROUP BY 1, 2), m AS (SELECT *, page < max(page) OVER (PARTITION BY event_type) AND NOT (event_type = 'error' AND page = 39) AS more FROM p),
e AS (SELECT *, CASE WHEN stops THEN 'caught_up' WHEN NOT more THEN 'store_exhausted' END AS reason FROM m WHERE page < 40),
w AS (SELECT event_type, least(coalesce(min(page) FILTER (WHERE reason IS NOT NULL), 39), max(page)) AS last FROM e GROUP BY 1)"""


def walks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ident = F.when(F.col("event_id") % 50 == 0, None).when(F.col("event_type") == "click", F.col("user_id")).when(F.col("event_type") == "purchase", F.col("user_id") * 10 + F.col("event_id") % 10).otherwise(F.col("event_id"))
    rows = e.select("event_type", "event_id", F.floor(F.col("event_id") / 200).alias("page"), ident.alias("id"))
    share = F.when(F.col("event_type") == "view", 97).when(F.col("event_type") == "purchase", 30).otherwise(0)
    rows = rows.withColumn("known", F.coalesce((F.col("id") * 7919) % 100 < share, F.lit(False)))
    last = F.max("page").over(Window.partitionBy("event_type"))
    tokens = rows.select("event_type", "page").distinct().withColumn("more", (F.col("page") < last) & ~((F.col("event_type") == "error") & (F.col("page") == 39)))
    return rows, tokens


@query(f"WITH {_WALKS} SELECT event_type, count(*) AS pages_fetched, CAST(sum(fresh) AS BIGINT) AS new_rows, coalesce(max(reason), 'max_pages') AS stop_reason FROM e JOIN w USING (event_type) WHERE page <= last GROUP BY 1")
def stop_reasons(spark, sf_dir):
    rows, tokens = walks(spark, sf_dir)
    return refresh.stop_reasons(rows, "event_type", "page", "event_id", F.col("known"), "id", 30, 40, tokens)


@query(f"WITH {_WALKS} SELECT event_type, page, event_id, id FROM k JOIN w USING (event_type) WHERE new = 1 AND page <= last")
def refresh_walk(spark, sf_dir):
    """What the stateful walk writes: every row that is new where it stands, up to the end of its walk."""
    rows, tokens = walks(spark, sf_dir)
    known = rows.where("known").select(F.col("event_type").alias("app_id"), F.col("id").alias("review_id"))
    pages = rows.join(tokens, ["event_type", "page"]).select(F.col("event_type").alias("app_id"), "page", F.col("event_id").alias("place"), F.col("id").alias("review_id"), F.col("id").cast("string").alias("review"), "more")
    out = walk(pages, known, 30, 40).where("stop_reason is null")
    return out.select(F.col("app_id").alias("event_type"), "page", F.col("place").alias("event_id"), F.col("review").cast("long").alias("id"))


@query("SELECT event_type, CAST(event_id // 500 + 1 AS BIGINT) AS page, event_id, user_id, event_id // 500 < max(event_id // 500) OVER (PARTITION BY event_type) AS more FROM events")
def landed_pages(spark, sf_dir):
    """All events, landed as pages in the shared folder and read back through the paged source."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("app_id"), (F.floor(F.col("event_id") / 500) + 1).alias("page"), F.col("event_id").alias("place"), F.to_json(F.struct(F.col("event_id").cast("string").alias("review_id"), "user_id")).alias("review"))
    last = e.groupBy("app_id").agg(F.max("page").alias("last"))
    root = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    paged.land_pages(e.join(F.broadcast(last), "app_id").withColumn("more", F.col("page") < F.col("last")), root)  # a row an app
    back = paged.read_pages(spark, root)
    return back.select(F.col("app_id").alias("event_type"), "page", F.col("review_id").cast("long").alias("event_id"), F.get_json_object("review", "$.user_id").cast("long").alias("user_id"), "more")


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, o_orderkey // 500 AS page, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE 700 END AS quota FROM orders), s AS (SELECT o_orderpriority AS p, page, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT p, page, coalesce(sum(n) OVER (PARTITION BY p ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT o_orderkey FROM r JOIN b ON p = o_orderpriority AND b.page = r.page WHERE quota IS NULL OR before < quota""")
def quota_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("page", F.floor(F.col("o_orderkey") / 500))
    return studies.quota_pages(rows, "o_orderpriority", "page", F.when(~F.col("o_orderpriority").startswith("1"), 700)).select("o_orderkey")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
def confirmed_apps(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = {r.n_name for r in n.where("n_regionkey = 1").select("n_name").collect()}
    return R.confirmed_apps(n.select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 1).alias("confirmed")), names).select("name")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def confirmed_listings(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    listings = n.select("n_name", "n_regionkey", F.col("n_regionkey").cast("string").alias("product_id"), F.when(F.col("n_nationkey") % 2 == 0, "google_play").otherwise("apple_app_store").alias("platform"), (F.col("n_nationkey") % 3 != 0).alias("confirmed"))
    return R.confirmed_listings(listings, "google_play").select("n_name", "n_regionkey")


@query("SELECT page_id FROM pages WHERE NOT (page_id % 2 = 0 AND page_id % 3 = 0 OR page_id % 2 = 1 AND page_id % 3 = 1)")
def wrong_addresses(spark, sf_dir):
    url = F.element_at(F.array(F.lit("https://play.google.com/store/apps/details?id=x"), F.lit("https://apps.apple.com/pk/app/id1"), F.lit("http://play.google.com/x")), (F.col("page_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "google_play").otherwise("apple_app_store").alias("platform"), url.alias("store_url"))
    return R.wrong_addresses(rows).select("page_id")


@query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL")
def judged_ids(spark, sf_dir):
    return R.judged_ids(table(spark, sf_dir, "conversations"), "conv_id")


@query("SELECT doc_id, text, quality FROM labels JOIN documents USING (doc_id)")
def judged_items(spark, sf_dir):
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    return studies.judged_items(own, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("item_id", "doc_id")


@query("SELECT n_nationkey, n_name AS token, 'en' AS lang, CASE WHEN n_regionkey = 0 THEN NULL ELSE 'pk' END AS country, CAST(n_regionkey AS INTEGER) AS sort, 200 AS count FROM nation WHERE n_nationkey % 4 <> 0")
def token_round_trip(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    none = F.lit(None).cast("int")
    made = F.struct(F.col("n_name").alias("token"), F.lit("en").alias("lang"), F.when(F.col("n_regionkey") != 0, "pk").alias("country"), F.col("n_regionkey").cast("int").alias("sort"), F.lit(200).alias("count"), none.alias("filter_score_with"), none.alias("filter_device_with"))
    back = n.select("n_nationkey", R.token_json(F.when(F.col("n_nationkey") % 4 != 0, made)).alias("j")).select("n_nationkey", R.token_of(F.col("j")).alias("t"))
    return back.where("t is not null").select("n_nationkey", "t.token", "t.lang", "t.country", "t.sort", "t.count")


@query("SELECT CASE WHEN n_regionkey = 0 THEN 'labels' ELSE 'r' || CAST(n_regionkey AS VARCHAR) END AS grp, string_agg(n_name, ',' ORDER BY n_nationkey) AS ids, min(n_nationkey) AS ord FROM nation GROUP BY 1")
def label_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("ord"), F.when(F.col("n_regionkey") != 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).otherwise("").alias("group"))
    return R.label_groups(rows).withColumn("ids", F.array_join("ids", ","))


@query("""SELECT conv_id, turn, json_extract_string(j, '$.label') AS label, json_extract_string(j, '$.secondary') AS secondary, CAST(json_extract(j, '$.blind') AS BOOLEAN) AS blind, list_aggregate(json_keys(j), 'string_agg', ',') AS keys
FROM (SELECT conv_id, turn, json_object('item_id', text, 'label', role, 'secondary', NULL, 'flags', NULL, 'notes', '', 'skipped', false, 'blind', turn % 2 = 0, 'label_version', 1, 'predictions', NULL) AS j FROM conversations)""")
def judgement_lines(spark, sf_dir):
    none = F.lit(None)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("item_id"), F.col("role").alias("label"), none.cast("string").alias("secondary"), none.cast("map<string,boolean>").alias("flags"), F.lit("").alias("notes"), F.lit(False).alias("skipped"), (F.col("turn") % 2 == 0).alias("blind"), F.lit(1).alias("label_version"), none.cast("map<string,string>").alias("predictions"))
    j = F.col("j")
    return rows.withColumn("j", R.judgement_json()).select("conv_id", "turn", F.get_json_object(j, "$.label").alias("label"), F.get_json_object(j, "$.secondary").alias("secondary"), F.get_json_object(j, "$.blind").cast("boolean").alias("blind"), F.array_join(F.json_object_keys(j), ",").alias("keys"))


@query("SELECT event_type, status, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS input_tokens FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'cached' ELSE 'error' END AS status FROM events) GROUP BY 1, 2")
def status_tally(spark, sf_dir):
    status = F.element_at(F.array(F.lit("ok"), F.lit("cached"), F.lit("error")), (F.col("event_id") % 3 + 1).cast("int"))
    return scoring.tally(table(spark, sf_dir, "events").select("event_type", status.alias("status"), F.col("user_id").alias("input_tokens")), "event_type")


@query("SELECT lang, source, count(*) AS in_source, count(*) FILTER (WHERE doc_id % 3 = 0) AS in_sample FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def sample_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return sampling.report(d, d.where("doc_id % 3 = 0"), ["lang", "source"])


@query(f"WITH {G.REVIEWS} SELECT id FROM reviews WHERE coalesce(nullif(rating, 0), 5) <= 2 AND {G.WORDS.format('text')} >= 20")
def complaint_rows(spark, sf_dir):
    return studies.complaints(G.reviews(spark, sf_dir), 2, 20).select("id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 101 >= 95 THEN 'about 9 in 10' ELSE (SELECT first(w ORDER BY abs(a - p_partkey % 101), k) FROM (VALUES (0, 90, 'about 9 in 10'), (1, 80, 'about 4 in 5'), (2, 75, 'about 3 in 4'), (3, 67, 'about 2 in 3'), (4, 60, 'about 3 in 5'), (5, 50, 'about half'), (6, 40, 'about 2 in 5'), (7, 33, 'about 1 in 3'), (8, 25, 'about 1 in 4'), (9, 20, 'about 1 in 5'), (10, 10, 'about 1 in 10')) s(k, a, w)) END AS share, CASE WHEN p_partkey % 101 >= 80 THEN 'strong' WHEN p_partkey % 101 >= 60 THEN 'moderate' WHEN p_partkey % 101 >= 40 THEN 'weak' ELSE 'little better than chance' END AS word FROM part")
def spoken(spark, sf_dir):
    n = F.col("p_partkey") % 101
    return table(spark, sf_dir, "part").select("p_partkey", scoring.spoken_share(n).alias("share"), scoring.kappa_word(n / 100).alias("word"))


# ---- text features over texts of both scripts

_TEXTS = (
    "My OTP nahi aya, the code is not received", "پیسے کٹ گئے اور او ٹی پی نہیں آیا", "app bohat slow hai yaar", "Transfer ki raqam نہیں ملی", "Great app, very good service", "Rs 500 deducted but balance kam", "login fail ho gaya, password wrong",
    "آپ کا ایجنٹ دھوکہ دیتا ہے", "fraud! someone hacked my account", "bill payment not updated", "qarz wapas nahi mila, refund chahiye", "SIM block kar di gayi", "loan installment extra charge", "kya hai yeh? kaise use karu", "☺☺", "card declined at the shop", "network down since 2 din", "helpline: koi response nahi", "uninstall kar raha hun", "5", "",
)
_ROWS = "t AS (SELECT p_partkey, (ARRAY[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _TEXTS) + f"])[p_partkey % {len(_TEXTS)} + 1] AS text FROM part)"


def texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("p_partkey") % len(_TEXTS) + 1).cast("int")).alias("text"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches(pattern: str) -> str:
    return f"regexp_matches(text, '(?i){_re2(pattern)}')"


@query(f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{tag}' AS tag, count(*) FILTER (WHERE {_matches(p)}) AS n FROM t" for tag, _, p in K.KEYWORD_GROUPS))
def catalogue_tags(spark, sf_dir):
    """All keyword groups of the catalogue."""
    rows = texts(spark, sf_dir)
    found = F.explode(F.array(*[F.struct(F.lit(tag).alias("tag"), X.has_keyword(tag, F.col("text")).cast("long").alias("hit")) for tag, _, _ in K.KEYWORD_GROUPS]))
    return rows.select(found.alias("f")).groupBy("f.tag").agg(F.sum("f.hit").alias("n"))


@query(f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{name}' AS intent, CAST(sum({' + '.join(f'CAST({_matches(p)} AS INTEGER)' for p in patterns)}) AS BIGINT) AS n FROM t" for name, patterns in K.SIGNAL_GROUPS))
def catalogue_signals(spark, sf_dir):
    """All signal groups of the catalogue."""
    rows = texts(spark, sf_dir)
    found = F.explode(F.array(*[F.struct(F.lit(name).alias("intent"), X.signal_score(F.col("text"), patterns).cast("long").alias("hits")) for name, patterns in K.SIGNAL_GROUPS]))
    return rows.select(found.alias("f")).groupBy("f.intent").agg(F.sum("f.hits").alias("n"))


_AR = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"
_BOTH = f"regexp_matches(text, '{_AR}') AND regexp_matches(text, '[A-Za-z]')"


@query(f"""WITH {_ROWS} SELECT p_partkey,
CASE WHEN {_BOTH} THEN 'code_switched' WHEN regexp_matches(text, '{_AR}') THEN 'urdu_script' WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])({G._MARKERS})(?:[^A-Za-z]|$)') THEN 'roman_urdu' ELSE 'english' END AS language,
CASE WHEN {_BOTH} THEN 'code_switched' WHEN regexp_matches(text, '{_AR}') THEN 'urdu_script' WHEN {_matches(chr(92) + "b(" + K.WIDE_ROMAN_MARKERS + ")" + chr(92) + "b")} THEN 'roman_urdu' ELSE 'english' END AS wide,
CASE WHEN {_BOTH} THEN 'mixed' WHEN regexp_matches(text, '{_AR}') THEN 'urdu_script' ELSE 'latin' END AS script,
{_matches(K.MONEY)} AND {_matches(K.LOSS)} AS loss, {_matches(K.SPECIFIC)} OR (1 + p_partkey % 5 <= 3 AND {G.WORDS.format("text")} > 12) AS concrete,
CASE WHEN {G.WORDS.format("text")} < 10 THEN 'short' WHEN {G.WORDS.format("text")} < 20 THEN 'medium' WHEN {G.WORDS.format("text")} < 40 THEN 'long' ELSE 'very_long' END AS bucket, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS title FROM t""")
def text_features(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select(
        "p_partkey", X.language(t).alias("language"), X.language_wide(t).alias("wide"), X.script(t).alias("script"), X.severity_proxy(t).alias("loss"),
        X.names_something_concrete(t, (1 + F.col("p_partkey") % 5).cast("int")).alias("concrete"), X.length_bucket(t).alias("bucket"), X.normal_title(t).alias("title"),
    )


@query(f"WITH {_ROWS}, c AS (SELECT text, count(*) AS k, min(p_partkey) AS ord FROM t GROUP BY 1) SELECT sha256(text) AS text_hash, ord, k FROM c")
def text_copies(spark, sf_dir):
    rows = texts(spark, sf_dir).select(X.text_hash(F.col("text")).alias("text_hash"), F.col("p_partkey").alias("ord"))
    return CL.first_wins(rows, "text_hash").join(rows.groupBy("text_hash").agg(F.count("*").alias("k")), "text_hash")


@query("SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS label_version FROM labels WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 9 FROM labels WHERE doc_id % 2 = 0")
def judgement_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("label_version"), F.col("doc_id").alias("ord"))
    new = old.where("doc_id % 2 = 0").withColumn("label_version", F.lit(9))
    return worklists.upsert(old, new, ("doc_id",)).select("doc_id", "label_version")


@query(f"""WITH late AS (SELECT item_id + 1000000000 AS id, text FROM benchmark UNION ALL SELECT CASE WHEN item_id % 2 = 0 THEN NULL ELSE item_id + 1000000000 END, 'another text <b>of</b> it' FROM benchmark WHERE item_id % 2 = 0
  UNION ALL SELECT item_id + 2000000000, CASE item_id % 3 WHEN 0 THEN 'two<br>words' WHEN 1 THEN '  App   bohat <b>acha</b> hai ' ELSE 'سروس بہت اچھی hai' END FROM benchmark UNION ALL SELECT doc_id, 'of an id that is there' FROM documents),
c AS (SELECT id, {G._CLEAN_SQL.format("text")} AS t FROM late WHERE id IS NOT NULL)
SELECT doc_id, text, lang AS language FROM documents UNION ALL
SELECT id, t, CASE WHEN regexp_matches(t, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'code_switched' WHEN regexp_matches(t, '(?i)(?:^|[^A-Za-z])({G._MARKERS})(?:[^A-Za-z]|$)') THEN 'roman_urdu' ELSE 'english' END
FROM c WHERE {G.WORDS.format("t")} >= 3 AND id NOT IN (SELECT doc_id FROM documents)""")
def corpus_with_refresh(spark, sf_dir):
    """The corpus and what came later, cleaned as it is read: tags and short texts go, the language is told, rows without an id and of known ids don't count."""
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text", F.col("lang").alias("language"), F.col("doc_id").alias("ord"))
    b = table(spark, sf_dir, "benchmark")
    ident = F.col("item_id") + 1_000_000_000
    odd = F.when(F.col("item_id") % 3 == 0, "two<br>words").when(F.col("item_id") % 3 == 1, "  App   bohat <b>acha</b> hai ").otherwise("سروس بہت اچھی hai")
    late = b.select(ident.alias("review_id"), "text", F.col("item_id").alias("ord"))
    late = late.unionByName(b.where("item_id % 2 = 0").select(F.lit(None).cast("long").alias("review_id"), F.lit("another text <b>of</b> it").alias("text"), (F.col("item_id") + 10**6).alias("ord")))
    late = late.unionByName(b.select((F.col("item_id") + 2_000_000_000).alias("review_id"), odd.alias("text"), F.col("item_id").alias("ord")))
    late = late.unionByName(corpus.select("review_id", F.lit("of an id that is there").alias("text"), "ord"))
    return refresh.with_refresh(corpus, late).select(F.col("review_id").alias("doc_id"), "text", "language")


@query(f"WITH {_ROWS} SELECT p_partkey FROM t WHERE {G.WORDS.format('text')} >= 3 AND p_partkey % 4 <> 0")
def admitted(spark, sf_dir):
    rows = texts(spark, sf_dir)
    known = rows.where("p_partkey % 4 = 0").select("p_partkey")
    return refresh.admit(rows.unionByName(rows), known, ("p_partkey",)).select("p_partkey")


# ---- vocabularies and addresses


@query("""SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de') GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source NOT IN (SELECT min(source) FROM documents) GROUP BY source
UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM labels JOIN documents USING (doc_id) WHERE quality IS NULL OR quality <> 1 GROUP BY quality""")
def vocabulary_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = d.agg(F.min("source")).first()[0]
    marked = table(spark, sf_dir, "labels").join(d, "doc_id")
    return labelling.outside_vocabulary(d, {"lang": ["en", "de"], "source": [first]}, optional=("source",)).unionByName(labelling.outside_vocabulary(marked, {"quality": ["1"]}))


@query("""SELECT CAST(count(DISTINCT doc_id) AS VARCHAR) || ' complaints, not 20' AS problem FROM documents HAVING count(DISTINCT doc_id) <> 20
UNION ALL SELECT 'nothing of nordic' FROM documents HAVING count(*) FILTER (lang IN ('sv', 'da')) = 0
UNION ALL SELECT 'nothing of german or english' FROM documents HAVING count(*) FILTER (lang IN ('de', 'en')) = 0""")
def authored_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("complaint_id"), F.col("lang").alias("gold_intent"))
    return labelling.authored_gaps(rows, {"nordic": ("sv", "da"), "german or english": ("de", "en")})


@query("SELECT s_suppkey, 'https://itunes.apple.com/pk/rss/customerreviews/page=' || (s_suppkey % 10 + 1) || '/id=' || s_suppkey || '/sortBy=mostRecent/json' AS address FROM supplier")
def page_addresses(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", labelling.apple_page_address(F.col("s_suppkey"), F.col("s_suppkey") % 10 + 1).alias("address"))
