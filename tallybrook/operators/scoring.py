"""Models against human judgements: accuracy, joint error, agreement, re-weighting and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions import stats as S
from tallybrook.functions.stats import pct, wilson
from tallybrook.operators.labels import canonical
from tallybrook.operators.worklists import answers, is_control, usable


def eligible(items: DataFrame, judgements: DataFrame, include_unblind: bool = False) -> DataFrame:
    """Items with a usable judgement, blind unless asked otherwise: item columns and `truth`.

    `__none__` and unclassifiable are one answer; pass labels through as they are to tell them apart.
    """
    own = judgements.where(usable(F.col("skipped"), F.col("label")))
    if not include_unblind:
        own = own.where("coalesce(blind, true)")
    return items.join(own.select(F.col("item_id").alias("id"), F.col("label").alias("truth"), *[c for c in ("secondary", "flags") if c in judgements.columns]), "id")


def _answers(pairs: DataFrame, strict: bool) -> DataFrame:
    rows = pairs.select("*", F.explode("predictions").alias("model", "answer")).where("answer is not null and answer <> ''")
    same = F.col("answer") == F.col("truth") if strict else canonical(F.col("answer")) == canonical(F.col("truth"))
    return rows.withColumn("hit", same.cast("long"))


def scored_answers(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """id, meta, truth, model, answer, correct: a row for each answer of a model to a judged item."""
    return _answers(pairs, strict).select("id", "meta", "truth", "model", "answer", (F.col("hit") == 1).alias("correct"))


def with_interval(rows: DataFrame, hits: str = "hits", total: str = "answered", z: float = S.Z) -> DataFrame:
    low, high = wilson(F.col(hits), F.col(total), z)
    return rows.withColumns({"rate": pct(F.col(hits), F.col(total)), "low": F.bround(100 * low, 1), "high": F.bround(100 * high, 1)})


def accuracy(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """model, hits, answered, with intervals; items that a model did not answer are left out."""
    return with_interval(_answers(pairs, strict).groupBy("model").agg(F.sum("hit").alias("hits"), F.count("*").alias("answered")))


def accuracy_by(pairs: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """By a field of meta; items without it are in group None."""
    group = F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit("None"))
    return with_interval(_answers(pairs, strict).groupBy("model", group.alias("group")).agg(F.sum("hit").alias("hits"), F.count("*").alias("answered")))


def joint_error(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """wrong, controls: items on which all models agree, and those where they agree on another label than the person."""
    first = answers(F.col("predictions"))[0]
    wrong = first != F.col("truth") if strict else canonical(first) != canonical(F.col("truth"))
    return with_interval(pairs.where(is_control(F.col("predictions"))).agg(F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("wrong"), F.count("*").alias("controls")), "wrong", "controls")


def reweighted_accuracy(pairs: DataFrame, population_agreement: float) -> DataFrame:
    """model, accuracy as if agreed and disputed items had the population's shares; unanswered items count against a
    model; null when either kind is missing."""
    models = pairs.select(F.explode(F.map_keys("predictions")).alias("model")).distinct()
    # Models are few; each item meets each of them by its own map, not by a join of items.
    names = models.agg(F.sort_array(F.collect_set("model")).alias("names"))
    rows = pairs.join(F.broadcast(names)).select("*", F.explode("names").alias("model"))
    hit = F.coalesce(canonical(F.try_element_at("predictions", F.col("model"))) == canonical(F.col("truth")), F.lit(False)).cast("long")
    agree = is_control(F.col("predictions"))
    sums = rows.groupBy("model").agg(F.count_if(agree).alias("n1"), F.count_if(~agree).alias("n0"), F.sum(F.when(agree, hit).otherwise(0)).alias("h1"), F.sum(F.when(~agree, hit).otherwise(0)).alias("h0"))
    w = population_agreement
    return sums.select("model", F.when((F.col("n1") > 0) & (F.col("n0") > 0), w * F.col("h1") / F.col("n1") + (1 - w) * F.col("h0") / F.col("n0")).alias("accuracy"))


def first_two_agreement(pairs: DataFrame) -> DataFrame:
    """Kappa of the first two models by name: n, agree, kappa (null where undefined)."""
    names = [r.model for r in pairs.select(F.explode(F.map_keys("predictions")).alias("model")).distinct().orderBy("model").limit(2).collect()]
    if len(names) < 2:
        return pairs.sparkSession.createDataFrame([], "n long, agree long, kappa double")
    a, b = (F.nullif(F.try_element_at("predictions", F.lit(m)), F.lit("")) for m in names)
    return S.kappa(pairs.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null"), "a", "b")


def power_report(pairs: DataFrame, key: str, rounds: int = 4000) -> DataFrame:
    """Per model: spread over groups, its p, the baseline and the smallest difference that could have been found."""
    rows = _answers(pairs, False).withColumn("group", F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit("None")))
    cells = rows.groupBy("model", "group").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    facts = cells.groupBy("model").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.max(F.col("hits") / F.col("n")) - F.min(F.col("hits") / F.col("n"))).alias("spread"), (F.sum("hits") / F.sum("n")).alias("baseline"), F.min("n").alias("smallest"))
    out = facts.join(S.permutation_tests(cells, "model", "group", rounds), "model")
    return out.select("model", "spread", "p", (F.col("p") < 0.05).alias("significant"), "baseline", "smallest", S.minimum_detectable_effect(F.col("baseline"), F.col("smallest")).alias("detectable"))


def winner(accuracies: DataFrame) -> DataFrame:
    """The best and the worst model, and whether the best is ahead for certain: its low end is above the other's high end."""
    best = F.max_by(F.struct("model", "rate", "low", "high"), F.struct("rate", "model")).alias("best")
    worst = F.min_by(F.struct("model", "rate", "low", "high"), F.struct("rate", "model")).alias("worst")
    return accuracies.agg(best, worst).withColumn("ahead", F.col("best.low") > F.col("worst.high"))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall in percent; null where undefined."""
    out = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    return out.withColumns({"precision": pct(F.col("tp"), F.col("tp") + F.col("fp")), "recall": pct(F.col("tp"), F.col("tp") + F.col("fn"))})


def pilot_score(rows: DataFrame) -> DataFrame:
    """model, language, correct, answered, errors: an error never counts as wrong, an unparseable reply does."""
    answered = F.col("status") != "error"
    return rows.groupBy("model", "language").agg(F.count_if(answered & F.coalesce("correct", F.lit(False))).alias("correct"), F.count_if(answered).alias("answered"), F.count_if(~answered).alias("errors"))


def pilot_gaps(scores: DataFrame, forms: list[str], base: str = "roman_urdu") -> DataFrame:
    """A row per model: accuracy of each form, and its distance from the base form."""
    table = scores.withColumn("pct", pct(F.col("correct"), F.col("answered"))).groupBy("model").pivot("language", forms).agg(F.first("pct"))
    return table.select("model", *forms, *[F.bround(F.col(f) - F.col(base), 1).alias(f"{f}_gap") for f in forms if f != base])


def decompose(rows: DataFrame, gaps: tuple[str, ...] = ("none", "__none__", "unclassifiable")) -> DataFrame:
    """kind, n over disagreements (a, b, truth): coverage_gap (no label for the person, one for both models) first, then a_right, b_right, neither."""
    gap = F.col("truth").isin(*gaps) & ~F.col("a").isin(*gaps) & ~F.col("b").isin(*gaps)
    kind = F.when(gap, "coverage_gap").when(F.col("a") == F.col("truth"), "a_right").when(F.col("b") == F.col("truth"), "b_right").otherwise("neither")
    return rows.where(F.col("a") != F.col("b")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def annotator_bias(rows: DataFrame) -> DataFrame:
    """Of disagreements that one model wins, the share of the first, and whether a half lies in its interval (no bias shown)."""
    won = rows.where("a <> b and (a = truth or b = truth)").agg(F.coalesce(F.sum((F.col("a") == F.col("truth")).cast("long")), F.lit(0)).alias("hits"), F.count("*").alias("answered"))
    low, high = wilson(F.col("hits"), F.col("answered"), S.Z_SCRIPTS)
    return won.withColumn("no_bias_shown", (low <= 0.5) & (high >= 0.5))


def agreement_report(rows: DataFrame, by: str) -> DataFrame:
    """n, agree, unclassifiable by either and by both, by group and over all (group null); studies.diagnostic_report() has the rest."""
    a, b = F.col("a"), F.col("b")
    none = F.lit("unclassifiable")
    return rows.rollup(by).agg(
        F.count("*").alias("n"), F.count_if(a == b).alias("agree"), F.count_if((a == none) | (b == none)).alias("either_none"), F.count_if((a == none) & (b == none)).alias("both_none"),
    )


def retest(first: DataFrame, second: DataFrame, key: str = "review_id", label: str = "label") -> DataFrame:
    """Both answers to the same question: key, a, b."""
    return first.select(key, F.col(label).alias("a")).join(second.select(key, F.col(label).alias("b")), key)


def confused_pairs(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Unordered pairs of labels that were taken for one another: x, y, n."""
    two = F.array_sort(F.array("a", "b"))
    return pairs.where("a <> b").groupBy(two[0].alias("x"), two[1].alias("y")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def complaint_mix(rows: DataFrame, group: str, label: str, groups: tuple[str, str], top: int = 12) -> DataFrame:
    """label, share in each of two groups, gap and whether it is over 3 points: the largest labels of both together."""
    cells = rows.where(F.col(group).isin(*groups) & (F.col(label) != "unclassifiable")).groupBy(label).pivot(group, list(groups)).agg(F.count(F.lit(1))).fillna(0)
    every = Window.partitionBy(F.lit(1))
    a, b = (F.col(f"`{g}`") for g in groups)
    shares = cells.select(F.col(label).alias("label"), (a + b).alias("n"), pct(a, F.sum(a).over(every)).alias("share_a"), pct(b, F.sum(b).over(every)).alias("share_b"))
    out = shares.withColumn("gap", F.bround(F.col("share_a") - F.col("share_b"), 1)).orderBy(F.desc("n"), "label").limit(top)
    return out.withColumn("marked", F.abs("gap") > 3)


def hunt_yield(rows: DataFrame) -> DataFrame:
    """hunted_for, candidates, hits, yield, verdict and the three labels found most instead."""
    hit = F.col("label") == F.col("hunted_for")
    sums = rows.groupBy("hunted_for").agg(F.count("*").alias("candidates"), F.count_if(hit).alias("hits"))
    other = rows.where(~hit).groupBy("hunted_for", "label").agg(F.count("*").alias("n"))
    order = Window.partitionBy("hunted_for").orderBy(F.desc("n"), "label")
    top = other.withColumn("k", F.row_number().over(order)).where("k <= 3").groupBy("hunted_for").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "label", "n"))), lambda e: F.struct(e["label"].alias("label"), e["n"].alias("n"))).alias("confusions"))
    verdict = F.when(F.col("hits") == 0, "absent").when(F.col("hits") < 5, "rare").otherwise("present")
    return sums.withColumns({"yield": pct(F.col("hits"), F.col("candidates")), "verdict": verdict}).join(top, "hunted_for", "left")


# The least kappa of each word, on the page and in the report of a retest.
RETEST_WORDS = ((0.80, "near-perfect"), (0.61, "substantial"), (0.41, "moderate"))


def retest_word(value: Column) -> Column:
    """How a retest's kappa is read: near-perfect only above its bound, the others from theirs on; null is unknown."""
    (top, best), *rest = RETEST_WORDS
    word = F.when(value > top, best)
    for least, name in rest:
        word = word.when(value >= least, name)
    return F.when(value.isNull(), "unknown").otherwise(word.otherwise("below moderate"))


def kappa_word(value: Column) -> Column:
    word = F.when(value >= 0.8, "strong").when(value >= 0.6, "moderate").when(value >= 0.4, "weak").otherwise("little better than chance")
    return F.when(value.isNull(), "unknown").otherwise(word)


def chance_word(p: Column) -> Column:
    """How often chance alone does as well."""
    whole = lambda c: F.round(c).cast("int").cast("string")
    rare = F.concat(F.lit("fewer than "), F.greatest(F.lit(1), F.round(100 * p).cast("int")).cast("string"), F.lit(" times in 100"))
    return F.when(p >= 0.5, F.concat(whole(10 * p), F.lit(" times out of 10"))).when(p >= 0.1, F.concat(F.lit("about "), whole(100 * p), F.lit(" times in 100"))).otherwise(rare)


# Spoken shares.
SPOKEN = (
    (90, "about 9 in 10"), (80, "about 4 in 5"), (75, "about 3 in 4"), (67, "about 2 in 3"), (60, "about 3 in 5"), (50, "about half"),
    (40, "about 2 in 5"), (33, "about 1 in 3"), (25, "about 1 in 4"), (20, "about 1 in 5"), (10, "about 1 in 10"),
)


def spoken_share(percent: Column) -> Column:
    """The nearest of the spoken shares; of two as near the first."""
    near = F.array_min(F.array(*[F.struct(F.abs(percent - at).alias("far"), F.lit(k).alias("k"), F.lit(words).alias("words")) for k, (at, words) in enumerate(SPOKEN)]))
    return near["words"]


def tally(rows: DataFrame, *by: str) -> DataFrame:
    """Answers and tokens by status."""
    tokens = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens") if c in rows.columns]
    return rows.groupBy(*by, "status").agg(F.count("*").alias("n"), *tokens)
