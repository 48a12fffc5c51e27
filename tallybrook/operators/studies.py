"""Reports of labelling studies, each a table of rates: section, key, hits, total, rate, low, high."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions import stats as S
from tallybrook.functions import text as X
from tallybrook.functions.stats import pct
from tallybrook.operators import scoring
from tallybrook.operators.worklists import answers
from tallybrook.sources.shared import materialise

NONE = "unclassifiable"
GAPS = (NONE, "none", "__none__")


def answered(rows: DataFrame) -> DataFrame:
    """Rows that a model answered, now or from its cache, with a label."""
    return rows.where(F.col("status").isin("ok", "cached") & F.col("label").isNotNull())


def complaints(rows: DataFrame, most: int = 2, least_words: int = 0, text: str = "text", rating: str = "rating") -> DataFrame:
    """Rows rated `most` stars at most (no rating counts as 5), of so many words at least."""
    return rows.where((X.rated(F.col(rating)) <= most) & X.has_words(F.col(text), least_words))


def _rates(facts: DataFrame, z: float = S.Z_SCRIPTS, shares: tuple[str, ...] = ()) -> DataFrame:
    """facts (section, key, hit) counted, with intervals; `shares` are sections whose total is all of their rows."""
    sums = facts.groupBy("section", "key").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("n"))
    every = F.sum("n").over(Window.partitionBy("section"))  # a row a key
    total = F.when(F.col("section").isin(*shares), every).otherwise(F.col("n")) if shares else F.col("n")
    return scoring.with_interval(sums.withColumn("total", total).select("section", "key", "hits", "total"), "hits", "total", z)


def _facts(rows: DataFrame, *facts: tuple) -> DataFrame:
    """(section, key, hit, whether the row counts) of each row, in one pass."""
    made = F.array(*[F.struct(F.lit(s).alias("section"), k.cast("string").alias("key"), F.coalesce(h, F.lit(False)).alias("hit"), w.alias("counts")) for s, k, h, w in facts])
    return rows.select(F.explode(made).alias("f")).select("f.*").where("counts").drop("counts")


def diagnostic_report(rows: DataFrame) -> DataFrame:
    """Two models' answers a, b to the same rows: language, rating, severity and severity_proxy, and of b, the model of reference,
    intent_secondary and refund_requested.

    Sections by language and over all (key null): unclassifiable_either, unclassifiable_both, multi_intent, agreement, refund;
    by rating: praise; complaints (two stars at most, key null): complaint_unclassifiable, complaint_both, complaint_agreement;
    as shares of all rows: severity, coverage; proxy: a row is a hit where the proxy and a financial loss agree, by "proxy/loss";
    proxy_precision (of flagged rows, those with a financial loss) and proxy_recall (of those with one, the flagged) with key null; kappa,
    by language and over all: the hits are agreements, and the column `kappa` is set (null where it is undefined, and elsewhere).
    """
    a, b, yes = F.col("a"), F.col("b"), F.lit(True)
    either, both = (a == NONE) | (b == NONE), (a == NONE) & (b == NONE)
    rating = X.rated(F.col("rating"))
    complaint = rating <= 2
    flags = (("unclassifiable_either", either), ("unclassifiable_both", both), ("multi_intent", F.coalesce("intent_secondary", F.lit("")) != ""), ("agreement", a == b), ("refund", F.col("refund_requested")))
    loss = F.col("severity") == "financial_loss"
    sign = lambda c: F.when(c, "+").otherwise("-")
    facts = [(s, k, h, yes) for s, h in flags for k in (F.col("language"), F.lit(None))]
    facts += [("praise", rating, b == NONE, yes)]
    facts += [(s, F.lit(None), h, complaint) for s, h in (("complaint_unclassifiable", b == NONE), ("complaint_both", both), ("complaint_agreement", a == b))]
    facts += [("severity", F.col("severity"), yes, yes), ("coverage", b, yes, yes), ("proxy", F.concat(sign(F.col("severity_proxy")), F.lit("/"), sign(loss)), F.col("severity_proxy") == loss, yes)]
    facts += [("proxy_precision", F.lit(None), loss, F.col("severity_proxy")), ("proxy_recall", F.lit(None), F.col("severity_proxy"), loss)]
    out = _rates(_facts(rows, *facts), shares=("severity", "coverage")).withColumn("kappa", F.lit(None).cast("double"))
    alike = S.kappa(rows, "a", "b", ["language"]).withColumnRenamed("language", "key").unionByName(S.kappa(rows, "a", "b").withColumn("key", F.lit(None).cast("string")))
    alike = alike.select(F.lit("kappa").alias("section"), "key", F.col("agree").alias("hits"), F.col("n").alias("total"), F.bround("kappa", 3).alias("kappa"))
    return out.unionByName(scoring.with_interval(alike, "hits", "total", S.Z_SCRIPTS).select(out.columns))


def disagreement_kind(a: Column, b: Column, truth: Column) -> Column:
    """coverage_gap (a person found no label, both models one) first, then a_right, b_right, neither."""
    gap = truth.isin(*GAPS) & ~a.isin(*GAPS) & ~b.isin(*GAPS)
    return F.when(gap, "coverage_gap").when(a == truth, "a_right").when(b == truth, "b_right").otherwise("neither")


def disagreement_study(rows: DataFrame) -> DataFrame:
    """Judged rows (a, b, truth, reason). Sections: kind (of disagreements), gap_reason, bias (a's share of what one model won; no bias
    shows where a half lies within low and high), both_wrong (of agreements), accuracy (a, b, both), none_reason."""
    a, b, truth, yes = F.col("a"), F.col("b"), F.col("truth"), F.lit(True)
    apart = a != b
    kind = disagreement_kind(a, b, truth)
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit("unrecorded"))
    facts = [("kind", kind, yes, apart), ("gap_reason", reason, yes, apart & (kind == "coverage_gap")), ("bias", F.lit("a"), kind == "a_right", apart & kind.isin("a_right", "b_right")), ("both_wrong", F.lit(None), a != truth, ~apart)]
    facts += [("accuracy", F.lit(name), hit, yes) for name, hit in (("a", a == truth), ("b", b == truth), ("both", (a == truth) & (b == truth)))]
    facts += [("none_reason", reason, yes, truth == NONE)]
    return _rates(_facts(rows, *facts), shares=("kind", "gap_reason", "none_reason"))


def population_disagreement(first: DataFrame, second: DataFrame, key: str = "review_id") -> DataFrame:
    """hits, total, rate: how often two models' answered rows (key, status, label) differ."""
    both = scoring.retest(answered(first), answered(second), key)
    return both.agg(F.count_if(F.col("a") != F.col("b")).alias("hits"), F.count("*").alias("total")).withColumn("rate", pct(F.col("hits"), F.col("total")))


def corrected_accuracy(rows: DataFrame, disagreement: DataFrame) -> DataFrame:
    """model, raw and corrected accuracy in percent: judged disagreements and agreements weighted as in the population (hits, total)."""
    apart, share = F.col("a") != F.col("b"), F.col("hits") / F.col("total")
    sums = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), apart.alias("apart"), (F.col(m) == F.col("truth")).alias("hit")) for m in ("a", "b")])).alias("f")).select("f.*")
    sums = sums.groupBy("model").agg(F.avg(F.when(F.col("apart"), F.col("hit").cast("int"))).alias("on_apart"), F.avg(F.when(~F.col("apart"), F.col("hit").cast("int"))).alias("on_alike"), F.avg(F.col("hit").cast("int")).alias("raw"))
    out = sums.join(F.broadcast(disagreement.select(share.alias("share"))))  # one row
    return out.select("model", F.bround(100 * F.col("raw"), 1).alias("raw"), F.bround(100 * (F.col("share") * F.col("on_apart") + (1 - F.col("share")) * F.col("on_alike")), 1).alias("corrected"))


def language_result(pairs: DataFrame, key: str, wide: float = 20.0) -> DataFrame:
    """model, spread (points), best, worst, verdict: the groups with the highest and the lowest accuracy; models with one group are left out."""
    cells = scoring.accuracy_by(pairs, key).withColumn("share", F.col("hits") / F.col("answered"))
    out = cells.groupBy("model").agg(F.count("*").alias("n"), (100 * (F.max("share") - F.min("share"))).alias("points"), F.min_by("group", F.struct(-F.col("share"), F.col("group"))).alias("best"), F.min_by("group", F.struct("share", "group")).alias("worst"))
    return out.where("n > 1").select("model", F.bround("points", 1).alias("spread"), "best", "worst", F.when(F.col("points") < wide, "no detectable gap").otherwise("gap").alias("verdict"))


def agreement_by(items: DataFrame, key: str) -> DataFrame:
    """group, hits, total: of all items, those whose models' answers are all the same one."""
    same = F.size(F.array_distinct(answers(F.col("predictions")))) == 1
    sums = items.groupBy(F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit("None")).alias("group")).agg(F.count_if(same).alias("hits"), F.count("*").alias("total"))
    return scoring.with_interval(sums, "hits", "total", S.Z_SCRIPTS)


def top_labels(rows: DataFrame, by: str, label: str, n: int = 3) -> DataFrame:
    """by, rank, label, n: the labels found most in each group."""
    order = Window.partitionBy(by).orderBy(F.desc("n"), "label")  # a row a label
    counts = rows.groupBy(by, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def authored_against_real(rows: DataFrame, real_hits: int, real_total: int) -> DataFrame:
    """Authored texts (language, gold, a, b; an answer may be null): section accuracy by model, agreement by language and over all (key
    null), and in the last the gap in points to the agreement on real texts."""
    a, b, gold, yes = F.col("a"), F.col("b"), F.col("gold"), F.lit(True)
    both = a.isNotNull() & b.isNotNull()
    out = _rates(_facts(rows, ("accuracy", F.lit("a"), a == gold, a.isNotNull()), ("accuracy", F.lit("b"), b == gold, b.isNotNull()), ("agreement", F.col("language"), a == b, both), ("agreement", F.lit(None), a == b, both)))
    gap = F.bround(100.0 * F.col("hits") / F.col("total") - 100.0 * real_hits / real_total, 1)
    return out.withColumn("gap", F.when((F.col("section") == "agreement") & F.col("key").isNull(), gap))


def trust_by_group(rows: DataFrame, group: str) -> DataFrame:
    """Rows (group, a, b, severity): severities as shares of their group, and how often the two models agree."""
    sums = rows.groupBy(group, "severity").agg(F.count("*").alias("n"))
    mix = sums.select(F.col(group).alias("group"), F.lit("severity").alias("section"), F.col("severity").alias("key"), "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy(group))).alias("rate"))
    same = rows.groupBy(F.col(group).alias("group")).agg(F.count_if(F.col("a") == F.col("b")).alias("n"), F.count("*").alias("total"))
    return mix.unionByName(same.select("group", F.lit("agreement").alias("section"), F.lit(None).cast("string").alias("key"), "n", pct(F.col("n"), F.col("total")).alias("rate")))


def score_report(items: DataFrame, judgements: DataFrame, by: str | None = None) -> DataFrame:
    """Everything that is known of the models in one table: section, model, group, hits, total, rate, low, high, kappa.

    Sections: items, judged, scored, excluded (counts in total); model; joint (all models agree on a label that the person did not
    give); agreement (of the first two models by name); group (by a field of meta, where a model has two groups or more).
    """
    pairs = materialise(scoring.eligible(items, judgements).select("id", "meta", "predictions", "truth"), "pairs")  # joined once for all sections
    counts = items.agg(F.count("*").alias("items")).join(judgements.agg(F.count("*").alias("judged"))).join(pairs.agg(F.count("*").alias("scored")))
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), v.alias("total")) for s, v in (("items", F.col("items")), ("judged", F.col("judged")), ("scored", F.col("scored")), ("excluded", F.col("judged") - F.col("scored")))])).alias("f")).select("f.*")

    def part(rows: DataFrame, section: str, hits: str = "hits", total: str = "answered", model="model", group=None, kappa=None) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(F.lit(section).alias("section"), (F.col(model) if model else none).alias("model"), (F.col(group) if group else none).alias("group"), F.col(hits).alias("hits"), F.col(total).alias("total"), "rate", "low", "high", (F.col(kappa) if kappa else F.lit(None).cast("double")).alias("kappa"))

    plain = counts.select("section", *[F.lit(None).cast("string").alias(c) for c in ("model", "group")], F.lit(None).cast("long").alias("hits"), "total", *[F.lit(None).cast("double").alias(c) for c in ("rate", "low", "high", "kappa")])
    out = plain.unionByName(part(scoring.accuracy(pairs), "model"))
    out = out.unionByName(part(scoring.joint_error(pairs).where("controls > 0"), "joint", "wrong", "controls", model=None))
    agree = scoring.first_two_agreement(pairs).where("n > 0").withColumn("kappa", F.bround("kappa", 3))
    out = out.unionByName(part(scoring.with_interval(agree, "agree", "n"), "agreement", "agree", "n", model=None, kappa="kappa"))
    if by is not None:
        cells = scoring.accuracy_by(pairs, by)
        several = cells.withColumn("_n", F.count("*").over(Window.partitionBy("model"))).where("_n > 1").drop("_n")
        out = out.unionByName(part(several, "group", group="group"))
    return out


def score(items: DataFrame, judgements: DataFrame, by: str | None = None, rounds: int = 4000) -> dict[str, DataFrame]:
    """All that a view of results shows, in one call: `report` (score_report()), `fields` (of meta, by which one can ask), and with `by`
    also `power`: model, spread (points), p, mde (points), needed, significant, for models with two groups or more."""
    out = {"report": score_report(items, judgements, by), "fields": items.select(F.explode(F.map_keys("meta")).alias("field")).distinct().orderBy("field")}
    if by is not None:
        pairs = scoring.eligible(items, judgements)
        several = scoring.accuracy_by(pairs, by).groupBy("model").agg(F.count("*").alias("n")).where("n > 1").select("model")
        found = scoring.power_report(pairs, by, rounds).join(several, "model", "left_semi")
        needed = F.when(F.col("spread") > 0, S.required_n(F.col("baseline"), F.col("spread")))
        out["power"] = found.select("model", F.bround(100 * F.col("spread"), 1).alias("spread"), F.bround("p", 3).alias("p"), F.bround(100 * F.col("detectable"), 1).alias("mde"), needed.alias("needed"), "significant")
    return out


def next_slice(rows: DataFrame, scores: dict, want: int, seen: DataFrame, skip: int = 50, least_words: int = 3, id_column: str = "review_id", text: str = "text") -> DataFrame:
    """intent, rank, id, hits: of each intent's ranking by signals, what follows the first `skip` and is not seen yet, the first `want`.

    All rows of enough words are ranked, seen ones too, so that runs go on down one ranking. What is wanted is among the first
    skip + want rows that are not seen; their ranks follow from how many seen rows come before each, which are counted, not sorted.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("intent"), c.cast("int").alias("hits")) for k, c in scores.items()]))
    scored = rows.where(X.has_words(F.col(text), least_words)).select(id_column, "ord", pairs.alias("e")).select(id_column, "ord", "e.*").where("hits > 0")
    scored = materialise(scored, "scored")  # ids and hits, without texts
    known = seen.select(id_column).distinct()
    place = F.struct((-F.col("hits")).alias("h"), F.col("ord").alias("o"))
    order = Window.partitionBy("intent").orderBy(F.desc("hits"), "ord")
    fresh = scored.join(known, id_column, "left_anti").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= skip + want)
    fresh = materialise(fresh, "slice")  # skip + want rows an intent at most
    ends = fresh.groupBy("intent").agg(F.array_sort(F.collect_list(place)).alias("ends"))
    before = scored.join(known, id_column, "left_semi").join(F.broadcast(ends), "intent").select("intent", (F.size(F.filter("ends", lambda e: e < place)) + 1).alias("_k"))
    before = before.groupBy("intent", "_k").agg(F.count("*").alias("_seen"))
    ranked = fresh.join(before, ["intent", "_k"], "left").withColumn("rank", (F.col("_k") + F.coalesce(F.sum("_seen").over(Window.partitionBy("intent").orderBy("_k")), F.lit(0))).cast("int"))
    return ranked.where(F.col("rank") > skip).withColumn("_n", F.row_number().over(Window.partitionBy("intent").orderBy("_k"))).where(F.col("_n") <= want).select("intent", "rank", id_column, "hits")


def quota_pages(rows: DataFrame, by: str, page: str, quota: Column) -> DataFrame:
    """Rows of the pages that a collection with a quota takes: the quota is looked at after each page, so the last one may go beyond it.
    A null quota takes all."""
    sizes = rows.groupBy(by, page).agg(F.count("*").alias("_n"), F.first(quota).alias("_quota"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = sizes.withColumn("_before", before).where("_quota is null or _before < _quota").select(by, page)
    return rows.join(taken, [by, page], "left_semi")


def at_most(rows: DataFrame, n: int | None) -> DataFrame:
    """All rows where there is no limit; 0 is a limit."""
    return rows if n is None else rows.limit(n)


def judged_items(judgements: DataFrame, items: DataFrame) -> DataFrame:
    """Judgements with the text of their items; one of an item that is not there fails."""
    found = judgements.join(items.select(F.col("id").alias("item_id"), F.col("text").alias("_text")), "item_id", "left")
    missing = F.raise_error(F.concat(F.lit("no item "), F.col("item_id"))).cast("string")
    return found.withColumn("text", F.when(F.col("_text").isNull(), missing).otherwise(F.col("_text"))).drop("_text")
