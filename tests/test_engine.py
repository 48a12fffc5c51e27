import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook import schemas
from tallybrook.functions import stats as S
from tallybrook.operators import clean, facets, labels, sampling, scoring, worklists


def raw(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schemas.of("review_id STRING, platform STRING, platform_app_id STRING, product_id STRING, text STRING, rating INT, timestamp STRING, app_version STRING, helpful_count LONG, ord LONG"))


def review(i, text, platform="google_play", rating=1):
    return (i, platform, "com.app", "old", text, rating, "2026-01-01", "1.0", 0)


def test_clean(spark):
    rows = raw(spark, [review("a", "  App   hang ho gaya hai "), review("a", "another text of it"), review("b", "App hang ho gaya hai"), review("c", "bilkul naya text hai"), review("d", "🔥"), review("e", None)])
    registry = spark.createDataFrame([("google_play", "com.app", "new")], "platform string, platform_app_id string, product_id string")
    kept, dropped = clean.clean(rows, registry)
    assert [(r.review_id, r.product_id, r.language) for r in kept.orderBy("ord").collect()] == [("a", "new", "roman_urdu"), ("c", "new", "roman_urdu")]
    assert {r.reason: r.n for r in dropped.collect()} == {"duplicate_id": 1, "duplicate_text": 1, "emoji_only": 1, "empty": 1}
    assert kept.columns == [*schemas.CLEAN_FIELDS, "ord"]


def test_rejected_row_reserves_nothing(spark):
    rows = raw(spark, [review("x", "first text of all"), review("y", "first text of all"), review("y", "second text of all"), review(None, "third text of all"), review(None, "fourth text of all")])
    kept, dropped = clean.clean(rows)
    assert [r.ord for r in kept.orderBy("ord").collect()] == [0, 2, 3]
    assert {r.reason: r.n for r in dropped.collect()} == {"duplicate_text": 1, "duplicate_id": 1}


@pytest.mark.parametrize("few", [0, 25, clean.FEW])
def test_two_keys_against_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(clean, "FEW", few)
    rng = random.Random(1)
    for n, ids, contents in ((40, 6, 6), (60, 30, 25), (30, 2, 20)) if few else ((60, 30, 25),):
        rows = [(k, f"i{rng.randrange(ids)}", f"c{rng.randrange(contents)}") for k in range(n)]
        rows = rows + [(n + k, None, f"c{k}") for k in range(3)] + [(n + 3 + k, f"i{k}", None) for k in range(3)]
        seen_i, seen_c, want = set(), set(), {}
        for k, i, c in rows:
            want[k] = "duplicate_id" if i in seen_i else "duplicate_text" if c in seen_c else "kept"
            if want[k] == "kept":
                seen_i.add(i)
                seen_c.add(c)
        got = clean.two_key_dedup(spark.createDataFrame(rows, "ord long, i string, c string").repartition(3), "i", "c")
        assert {r.ord: r.verdict for r in got.collect()} == want


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    rows = spark.range(n).select(F.concat(F.lit("i"), F.floor(F.col("id") / 2)).alias("i"), F.concat(F.lit("c"), F.floor((F.col("id") + 1) / 2)).alias("c"), F.col("id").alias("o"))
    kept, rounds = clean.first_matching(rows, few=0)
    assert rounds < 20 and sorted(r.o for r in kept.select("o").collect()) == list(range(0, n, 2))
    from tallybrook.sources import shared

    assert sum("/rows-" in p or "/chains-" in p or "/firsts-" in p for p in shared._WRITTEN) == 0


SMALL = "id string, text string, platform string, product string, rating int, language string, date string, version string, label string, label_source string, ord long"


def slice_of(spark, rows):
    return facets.review_view(spark.createDataFrame(rows, SMALL))


def one(k, **more):
    base = dict(id=f"r{k}", text="some words here", platform="google_play", product="wallet_a", rating=1, language="english", date=f"2026-01-{k % 28 + 1:02d}", version="1.0", label=None, label_source=None, ord=k)
    return tuple((base | more)[c.split()[0]] for c in SMALL.split(", "))


def test_filters_and_pages(spark):
    rows = slice_of(spark, [one(0), one(1, product="wallet_b"), one(2, rating=5), one(3, text="money deducted, no response"), one(4, text="پیسے غائب ہیں", rating=None)])
    pick = lambda f: sorted(r.id for r in facets.select(rows, f).collect())
    assert pick(facets.Filters(products={"wallet_a"}, ratings={1})) == ["r0", "r3"]
    assert pick(facets.Filters(tags={"money_lost", "support"})) == ["r3"]
    assert pick(facets.Filters(search="پیسے")) == ["r4"] and pick(facets.Filters(search="DEDUCTED")) == ["r3"]
    assert pick(facets.Filters(tags={"unknown"})) == [] and len(pick(facets.Filters())) == 5
    assert pick(facets.Filters(labelled_only=True)) == [] and pick(facets.Filters(min_words=4)) == ["r3"]
    q = facets.Filters.from_query("rating=1,banana,3&product=a&product=b,c&minwords=x&q= Hi ")
    assert (q.ratings, q.products, q.min_words, q.search) == ({1, 3}, {"a", "b", "c"}, 0, "Hi")
    many = slice_of(spark, [one(k) for k in range(85)])
    assert [facets.page(many, n).count() for n in range(4)] == [40, 40, 5, 0]
    assert tuple(facets.pages(many).first()) == (85, 3) and tuple(facets.pages(many.where("false")).first()) == (0, 1)
    first = facets.page(many, 0).first()
    assert first.date == "2026-01-28" and first.id == "r27"


def test_aggregates(spark):
    rows = slice_of(spark, [one(k, version="9.9" if k < 5 else "1.0", rating=1 if k % 2 else 5) for k in range(65)])
    (release,) = facets.releases(rows).collect()
    assert (release.version, release.total, release.bad) == ("1.0", 60, 30) and release.bad_pct == 50.0 and release.low < 50 < release.high
    groups = {r.key: r for r in facets.breakdown(rows, "rating").collect()}
    assert groups["5"].total == 33 and groups["5"].bad == 0 and groups["1"].share == 49.2
    odd = slice_of(spark, [one(0, rating=0), one(1, rating=None), one(2, version="")])
    assert {r.key: r.total for r in facets.breakdown(odd, "rating").collect()} == {"—": 2, "1": 1}
    facts = facets.summary(rows, 650).first()
    assert (facts.total, facts.share_of_corpus, facts.median_words, facts.labelled_pct) == (65, 10.0, 3, 0.0)
    empty = facets.summary(rows.where("false"), 65).first()
    assert (empty.total, empty.labelled_pct, empty.median_words) == (0, None, 0)
    months = slice_of(spark, [one(k, date=f"20{20 + k // 12}-{k % 12 + 1:02d}-01") for k in range(30)] + [one(99, date="")])
    found = [r.month for r in facets.trend(months).collect()]
    assert len(found) == 24 and found == sorted(found) and found[-1] == "2022-06"
    mix = slice_of(spark, [one(0, label="x", label_source="model"), one(1, label="x", label_source="human"), one(2)])
    (m,) = facets.label_mix(mix).collect()
    assert (m.of_labelled, m.human, m.share) == (2, 1, 100.0)
    out = facets.export_rows(mix).first().asDict()
    assert set(out) == {"id", "text", "meta"} and "label" not in out["meta"]
    values = [r.value for r in facets.values(rows, "version").collect()]
    assert values == ["1.0", "9.9"]
    with facets.Report(rows, facets.Filters(ratings={1})) as report:
        tables = report.tables()
        assert tables["summary"].first().total == 32 and tables["page"].count() == 32


def test_median(spark):
    for n in (1, 2, 5, 8):
        v = [random.Random(n).randrange(4) for _ in range(n)]
        assert facets.upper_median(spark.createDataFrame([(x,) for x in v], "w int"), "w").first().median == sorted(v)[n // 2]


def test_wilson_and_power(spark):
    rows = spark.createDataFrame([(0, 5), (5, 5), (0, 0), (30, 60)], "h int, n int")
    got = [tuple(r) for r in rows.select(*S.wilson(F.col("h"), F.col("n"))).collect()]
    assert got[2] == (0.0, 0.0) and all(0 <= a <= b <= 1 for a, b in got) and got[3][0] < 0.5 < got[3][1]
    mde = [r[0] for r in spark.createDataFrame([(50,), (100,), (200,), (400,), (0,)], "n int").select(F.round(100 * S.minimum_detectable_effect(F.lit(0.609), F.col("n")), 1)).collect()]
    assert mde == [27.3, 19.3, 13.7, 9.7, 100.0]
    n = spark.range(1).select(S.required_n(F.lit(0.6), S.minimum_detectable_effect(F.lit(0.6), F.lit(50))), S.required_n(F.lit(0.5), F.lit(0.0))).first()
    assert abs(n[0] - 50) <= 2 and n[1] == 0
    assert [r[0] for r in spark.createDataFrame([(1, 16), (3, 16)], "h int, n int").select(S.pct(F.col("h"), F.col("n"))).collect()] == [6.2, 18.8]


def test_kappa(spark):
    def of(pairs):
        return S.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()

    assert of([("x", "x"), ("y", "y")]).kappa == pytest.approx(1.0)
    assert of([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]).kappa == pytest.approx(0.0)
    assert of([("x", "x")] * 3).kappa is None


def test_permutation(spark):
    def p(rows):
        return S.permutation_test(spark.createDataFrame(rows, "g string, hit boolean"), "g", "hit", 4000, 1).first()

    split = [("a", True)] * 50 + [("b", False)] * 50
    flat = [(g, k % 2 == 0) for g in "abc" for k in range(40)]
    assert p(split).p < 0.01 and p(flat).p > 0.05 and p(flat).observed == 0.0
    assert p([("a", True)] * 5).p == 1.0
    rng, rows = random.Random(3), [(g, k < h) for g, n, h in (("a", 50, 33), ("b", 51, 31), ("c", 55, 37), ("d", 48, 27)) for k in range(n)]
    hits, sizes = [r[1] for r in rows], [50, 51, 55, 48]
    seen = 0
    for _ in range(3000):
        rng.shuffle(hits)
        at, rates = 0, []
        for n in sizes:
            rates.append(sum(hits[at : at + n]) / n)
            at += n
        seen += max(rates) - min(rates) >= 37 / 55 - 27 / 48 - 1e-12
    assert abs(p(rows).p - seen / 3000) < 0.05


def case(spark):
    items = [("a", {"lang": "ur"}, {"m": "x", "n": "x"}), ("b", {"lang": "ur"}, {"m": "x", "n": "y"}), ("c", {}, {"m": "x"}), ("d", {"lang": "en"}, {"m": "y", "n": "y"}), ("e", {"lang": "en"}, {"m": "unclassifiable", "n": ""})]
    items = spark.createDataFrame([(i, f"text {i}", m, p) for i, m, p in items], schemas.ITEM)
    j = [("a", "x", False, True, 1), ("b", "y", False, True, 2), ("c", "x", True, True, 1), ("d", "x", False, False, 1), ("e", "__none__", False, True, 1)]
    judgements = spark.createDataFrame([(*r, k) for k, r in enumerate(j)], "item_id string, label string, skipped boolean, blind boolean, label_version int, ord long")
    return items, judgements


def test_scoring(spark):
    items, judgements = case(spark)
    pairs = scoring.eligible(items, judgements)
    assert sorted(r.id for r in pairs.collect()) == ["a", "b", "e"]
    assert scoring.eligible(items, judgements, True).count() == 4
    got = {r.model: (r.hits, r.answered) for r in scoring.accuracy(pairs).collect()}
    assert got == {"m": (2, 3), "n": (2, 2)}
    assert {r.model: r.hits for r in scoring.accuracy(pairs, strict=True).collect()}["m"] == 1
    by = {(r.model, r.group): (r.hits, r.answered) for r in scoring.accuracy_by(pairs, "lang").collect()}
    assert by[("m", "ur")] == (1, 2) and by[("m", "en")] == (1, 1)
    wrong = scoring.joint_error(scoring.eligible(items, judgements, True)).first()
    assert (wrong.wrong, wrong.controls) == (1, 2)
    agree = spark.createDataFrame([(f"i{k}", "", {}, {"m": "x", "n": "x" if k < 10 else "y"}, "x" if k < 10 else "z") for k in range(20)], "id string, text string, meta map<string,string>, predictions map<string,string>, truth string")
    assert {r.model: r.accuracy for r in scoring.reweighted_accuracy(agree, 0.8).collect()} == {"m": 0.8, "n": 0.8}
    assert scoring.reweighted_accuracy(agree.limit(0).unionByName(agree.where("truth = 'x'")), 0.8).first().accuracy is None
    assert scoring.winner(scoring.accuracy(agree)).first().ahead is False
    assert scoring.first_two_agreement(agree).first().agree == 10
    assert {r.model for r in scoring.power_report(pairs, "lang", 500).collect()} == {"m", "n"}


def test_worklists(spark):
    items, judgements = case(spark)
    few = judgements.where("item_id in ('b', 'c')")

    def ids(mode, **more):
        return sorted(r.id for r in worklists.worklist(items, few, mode, **more).collect())

    assert ids("all") == ["a", "d", "e"] and ids("controls") == ["a", "d"] and ids("recheck") == ["b", "c"] and ids("revisit", label_version=2) == ["c"]
    assert len(ids("all", limit=2)) == 2
    order = [r.id for r in worklists.worklist(items, few, "all", seed=4).collect()]
    assert order == [r.id for r in worklists.worklist(items.repartition(3), few, "all", seed=4).collect()]
    again = few.withColumn("pass_id", F.when(F.col("item_id") == "b", "second").otherwise("first"))
    assert [r.id for r in worklists.worklist(items, again, "recheck", pass_id="second").collect()] == ["c"]
    assert tuple(worklists.counts(items, few, 2).first()) == (3, 2, 2, 1)
    assert tuple(worklists.progress(items, few, "all").first()) == (2, 5) and tuple(worklists.progress(items, few, "revisit", 2).first()) == (1, 5)
    assert "predictions" not in worklists.public_view(items).columns
    with pytest.raises(ValueError):
        worklists.worklist(items, few, "other")
    new = judgements.where("item_id = 'b'").withColumns({"label": F.lit("changed"), "ord": F.lit(0).cast("long")})
    both = {r.item_id: r.label for r in worklists.upsert(judgements, new).collect()}
    assert both["b"] == "changed" and len(both) == 5
    assert worklists.nth_latest(judgements, 2).first().item_id == "d"


def test_labels(spark):
    model = spark.createDataFrame([("a", "first", 0), ("a", "second", 1), ("b", "m", 2)], "review_id string, label string, ord long")
    human = spark.createDataFrame([("a", "old", False, 0), ("a", "new", False, 1), ("a", "skip", True, 2), ("b", "", False, 3)], "review_id string, label string, skipped boolean, ord long")
    got = {r.review_id: (r.label, r.label_source) for r in labels.resolve_labels(model, human).collect()}
    assert got == {"a": ("new", "human"), "b": ("m", "model")}
    sizes = spark.createDataFrame([(0,), (10,), (29,), (2,)], "f int").select(labels.draw_size(F.col("f")))
    assert [r[0] for r in sizes.collect()] == [400, 100, 25, 400]


def test_samples(spark):
    rows = spark.createDataFrame([(f"r{s}{k}", s, k, k) for s, n in (("a", 1), ("b", 5), ("c", 5)) for k in range(n)], "review_id string, s string, k int, ord long")
    sizes = lambda df: sorted(r["count"] for r in df.groupBy("s").count().collect())
    assert sizes(sampling.round_robin(rows, ["s"], 7, 1)) == [1, 3, 3]
    for bad in (0, -1, 12):
        with pytest.raises(ValueError):
            sampling.round_robin(rows, ["s"], bad, 1)
    assert sizes(sampling.first_per_slice(rows, ["s"], 2)) == [1, 2, 2]
    quota = sampling.quota_sample(rows, "s", F.col("k") < 2, 4, 1, 1)
    assert sizes(quota) == [1, 4, 4] and quota.where("k < 2").count() == 3
    assert sampling.quotas(10) == {"urdu_script": 3, "roman_urdu": 3, "english": 2, "code_switched": 2}
    audit = rows.withColumns({"language": F.col("s"), "text_clean": F.lit("x"), "text_scrubbed": F.when(F.col("k") == 4, "y").otherwise("x")})
    got = sampling.audit_sample(audit, 3, 1, ("b", "c"))
    assert got.where("k = 4").count() == 2 and got.count() == 3
    with pytest.raises(ValueError):
        sampling.audit_sample(audit, 9, 1, ("a", "b"))
    text = spark.createDataFrame([(f"{g}{k}", g, " ".join(["w"] * (5 if k < 6 else 30))) for g, n in (("u", 8), ("e", 20)) for k in range(n)], "review_id string, language string, text string")
    drawn = sampling.length_matched(text, "language", "u", 4, 1)
    assert {(r.language, r.bucket): r["count"] for r in drawn.groupBy("language", "bucket").count().collect()} == {("u", "short"): 3, ("u", "long"): 1, ("e", "short"): 3, ("e", "long"): 1}


def test_reports(spark):
    rows = spark.createDataFrame([("m", "en", True, "ok"), ("m", "en", False, "unparseable"), ("m", "en", None, "error"), ("m", "roman_urdu", True, "ok")], "model string, language string, correct boolean, status string")
    got = {r.language: (r.correct, r.answered, r.errors) for r in scoring.pilot_score(rows).collect()}
    assert got == {"en": (1, 2, 1), "roman_urdu": (1, 1, 0)}
    assert scoring.pilot_gaps(scoring.pilot_score(rows), ["en", "roman_urdu"]).first().en_gap == -50.0
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x"), ("z", "y")], "a string, b string")
    assert [tuple(r) for r in scoring.confused_pairs(pairs).collect()] == [("x", "y", 2)]
    truth = spark.createDataFrame([("a", "b", "a"), ("a", "b", "b"), ("a", "b", "c"), ("a", "b", "none"), ("a", "a", "b")], "a string, b string, truth string")
    assert {r.kind: r.n for r in scoring.decompose(truth).collect()} == {"a_right": 1, "b_right": 1, "neither": 1, "coverage_gap": 1}
    assert scoring.annotator_bias(truth).first().no_bias_shown
    hunt = spark.createDataFrame([("i", "i"), ("i", "j"), ("i", "j"), ("k", "z")], "hunted_for string, label string")
    found = {r.hunted_for: r for r in scoring.hunt_yield(hunt).collect()}
    assert found["i"].verdict == "rare" and found["k"].verdict == "absent" and found["i"].confusions[0].n == 2
    assert np.isclose(found["i"]["yield"], 33.3)


def test_display_of_a_review(spark):
    import json

    (row,) = facets.display_json(slice_of(spark, [one(3, text="ok <b>", label=None)])).collect()
    assert row.id == "r3" and json.loads(row.json) == {"id": "r3", "text": "ok <b>", "platform": "google_play", "product": "wallet_a", "rating": 1, "language": "english", "date": "2026-01-04", "version": "1.0", "label": None, "label_source": None}


def test_keywords_are_described(spark):
    from tallybrook.functions import catalogue as K

    got = facets.describe_keywords(spark).collect()
    assert len(got) == len(K.KEYWORD_GROUPS) and [r[0] for r in got] == [g[0] for g in K.KEYWORD_GROUPS]


def test_words_of_chance(spark):
    rows = spark.createDataFrame([(p,) for p in (0.001, 0.049, 0.05, 0.3, 0.9)], "p double")
    words = [r.w for r in rows.select(scoring.chance_word(F.col("p")).alias("w"), "p").orderBy("p").collect()]
    assert words == ["fewer than 1 times in 100", "fewer than 5 times in 100", "fewer than 5 times in 100", "about 30 times in 100", "9 times out of 10"]


def test_at_most(spark):
    from tallybrook.operators import studies

    rows = spark.range(10)
    assert [studies.at_most(rows, n).count() for n in (None, 0, 3, 20)] == [10, 0, 3, 10]


def test_disputed_rows_and_controls(spark):
    rows = spark.createDataFrame([(f"r{k}", k % 4 == 0, k % 4 == 1) for k in range(100)], "review_id string, disputed boolean, control boolean")
    got = [r.review_id for r in sampling.disputed_and_controls(rows, F.col("disputed"), F.col("control"), 6, 2).collect()]
    again = [r.review_id for r in sampling.disputed_and_controls(rows.repartition(5), F.col("disputed"), F.col("control"), 6, 2).collect()]
    kinds = [int(r[1:]) % 4 for r in got]
    assert got == again and (kinds.count(0), kinds.count(1), len(kinds)) == (25, 6, 31) and kinds != sorted(kinds)
    assert sampling.disputed_and_controls(rows, F.col("disputed"), F.col("control"), 0, 2).count() == 25


def test_records_with_personal_data(spark):
    from tallybrook.functions import pii

    rows = spark.createDataFrame([("call 0300 1234567 now",), ("nothing here",), ("a@b.example and c@d.example",), (None,)], "text_clean string")
    found = pii.records_with_pii(pii.scrub(rows)).first()
    assert (found.records, found.with_pii) == (4, 2)


def test_filters_of_report_tables(spark):
    rows = [("a", "core", "wallet", "ok"), ("b", "core", "bank", "ok"), ("c", "extended", "wallet", "ok"), ("d", "core", "wallet", "error"), ("e", None, "wallet", "ok")]
    df = spark.createDataFrame(rows, "product string, inclusion_tier string, vertical string, status string")
    chosen = lambda **more: sorted(r[0] for r in facets.select(df, facets.Filters(more={k: set(v) for k, v in more.items()})).collect())
    assert chosen() == list("abcde") and chosen(inclusion_tier=[], vertical=[]) == list("abcde")
    assert chosen(inclusion_tier=["core"], vertical=["wallet"], status=["ok"]) == ["a"]
    assert chosen(inclusion_tier=["core", "extended"], status=["ok"]) == ["a", "b", "c"]


def test_words_of_a_retest(spark):
    rows = spark.createDataFrame([(k,) for k in (0.81, 0.8, 0.61, 0.6, 0.41, 0.4, None)], "k double")
    assert [r[0] for r in rows.select(scoring.retest_word(F.col("k"))).collect()] == ["near-perfect", "substantial", "substantial", "moderate", "moderate", "below moderate", "unknown"]
